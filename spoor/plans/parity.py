"""Queries comparing two recorders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spoor.functions import network as net, process as proc
from spoor.operators import behavior, parity
from spoor.plans import bridge
from spoor.plans.security import BASE

Q, SQL = {}, {}


def sides(spark, d) -> DataFrame:
    """Every two neighbouring versions of a package stand for two recorders of one workload."""
    events = bridge.events(spark, d)
    pairs = behavior.version_pairs(behavior.recordings_of(events)).withColumn("pair_id", F.concat("package", F.lit(":"), "before_version"))
    side = lambda of, n: F.struct(F.col(of).alias("recording_id"), F.lit(n).alias("side"))
    sides = pairs.select("pair_id", F.explode(F.array(side("before_id", 1), side("after_id", 2))).alias("s")).select("pair_id", "s.*")
    # A recording is the second side of one pair and the first of the next.
    return _facts(events.join(sides.hint(parity.SHUFFLED), "recording_id").withColumn("recording_id", F.concat("pair_id", F.lit("/"), F.col("side").cast("string"))))


def recorder_sides(spark, d) -> DataFrame:
    """The same of every recording."""
    return _facts(bridge.recorder_sides(spark, d))


def _facts(rows: DataFrame) -> DataFrame:
    path = F.when((F.col("side") == 1) & (F.col("origin") == "unresolved"), F.concat(F.lit("/work/x/"), "path")).otherwise(F.col("path"))
    pairs = rows.select("recording_id", "pair_id", "side").distinct()
    return parity.facts(rows.withColumn("path", path)).join(pairs.hint(parity.SHUFFLED), "recording_id").drop("recording_id")


FACTS = (
    BASE
    + """, nv AS (SELECT package, version AS v1, lead(version) OVER (PARTITION BY package ORDER BY first_seen) AS v2 FROM (SELECT package, version, min(append_pos) AS first_seen FROM b GROUP BY ALL)
), sd AS (SELECT package, v1 AS version, package || ':' || v1 AS pair_id, 1 AS side FROM nv WHERE v2 IS NOT NULL UNION ALL SELECT package, v2, package || ':' || v1, 2 FROM nv WHERE v2 IS NOT NULL
), q AS (SELECT p.*, pair_id, side, CASE WHEN side = 1 AND origin = 'unresolved' THEN '/work/x/' || path ELSE path END AS npath FROM p JOIN sd USING (package, version)
), fa AS (
  SELECT DISTINCT pair_id, side, CASE op WHEN 'fs_write' THEN 'write' WHEN 'fs_read' THEN 'read' WHEN 'net_connect' THEN 'connected' WHEN 'dns_query' THEN 'resolved' ELSE 'spawned' END AS class,
    CASE WHEN op IN ('fs_write', 'fs_read') THEN npath END AS path, CASE WHEN op = 'fs_write' THEN kind END AS kind, CASE WHEN op = 'net_connect' THEN ip END AS ip, CASE WHEN op = 'net_connect' THEN port END AS port,
    CASE WHEN op = 'dns_query' THEN lower(qname) END AS qname, CASE WHEN op = 'proc_spawn' THEN prog END AS program
  FROM q WHERE NOT (failed AND op IN ('fs_write', 'fs_read', 'net_connect'))
), df AS (
  SELECT pair_id, class, path, kind, ip, port, qname, program, CASE WHEN bool_or(side = 1) AND bool_or(side = 2) THEN 'both' WHEN bool_or(side = 1) THEN 'first' ELSE 'second' END AS seen_by
  FROM fa GROUP BY pair_id, class, path, kind, ip, port, qname, program
), kg AS (SELECT *, CASE WHEN kind IN ('open', 'write', 'create', 'truncate') THEN 'content' ELSE coalesce(kind, 'read') END AS kind_group FROM fa WHERE path IS NOT NULL
), rc2 AS (SELECT DISTINCT x.pair_id, x.side, x.path, x.kind_group, y.side AS o_side, y.path AS o_path FROM kg x JOIN kg y ON x.pair_id = y.pair_id AND x.side <> y.side AND x.kind_group = y.kind_group AND x.path LIKE '/%' AND y.path NOT LIKE '/%' AND ends_with(x.path, '/' || y.path)
), cp AS (SELECT pair_id, side, path, kind_group FROM rc2 UNION SELECT pair_id, o_side, o_path, kind_group FROM rc2
), md AS (
  SELECT DISTINCT m.pair_id, m.path FROM fa m JOIN fa w ON w.pair_id = m.pair_id AND w.class = 'write' AND w.path <> m.path WHERE m.class = 'write' AND m.kind = 'mkdir' AND m.side = 2
    AND CASE WHEN m.path LIKE '/%' THEN starts_with(w.path, m.path) ELSE contains(w.path, '/' || m.path || '/') OR ends_with(w.path, '/' || m.path) END
), cmp AS (
  SELECT df.*, CASE
      WHEN seen_by = 'first' AND class = 'write' AND df.path = '/dev/null' THEN 'null_device'
      WHEN seen_by = 'first' AND class = 'write' AND (contains(df.path, 'command-stderr.log') OR contains(df.path, 'command-stdout.log')) THEN 'recorder_output'
      WHEN class = 'write' AND cp.path IS NOT NULL THEN 'other_notation'
      WHEN seen_by = 'first' AND class IN ('read', 'resolved', 'spawned') THEN 'not_observed_by_second'
      WHEN seen_by = 'first' AND class = 'write' AND df.path NOT LIKE '/%' THEN 'relative_path'
      WHEN seen_by = 'second' AND kind = 'mkdir' AND md.path IS NOT NULL THEN 'parent_directory'
      WHEN seen_by = 'second' AND class = 'read' AND cp.path IS NOT NULL THEN 'other_notation'
      WHEN seen_by = 'second' AND class = 'spawned' THEN 'spawn_timing' END AS reason
  FROM df LEFT JOIN cp ON cp.pair_id = df.pair_id AND cp.path = df.path AND cp.side = CASE WHEN seen_by = 'first' THEN 1 ELSE 2 END AND cp.kind_group = CASE WHEN kind IN ('open', 'write', 'create', 'truncate') THEN 'content' ELSE coalesce(kind, 'read') END
    LEFT JOIN md ON md.pair_id = df.pair_id AND md.path = df.path WHERE seen_by <> 'both'
)
"""
)


def _add(name, f, sql):
    Q[name], SQL[name] = f, sql


#: The same over every recording: no version is left out.
EVERY = FACTS.replace("SELECT p.*, pair_id, side,", "SELECT *, recording_id // 2 AS pair_id, recording_id % 2 + 1 AS side,").replace("WHEN side = 1 AND origin", "WHEN recording_id % 2 = 0 AND origin").replace(" FROM p JOIN sd USING (package, version)", " FROM p")


def _add_both(name, f, sql):
    _add(name, lambda s, d: f(sides(s, d)), FACTS + sql)
    _add(f"recorder_{name}", lambda s, d: f(recorder_sides(s, d)), EVERY + sql)


_add_both("facts", lambda rows: rows, "SELECT * FROM fa")
_add_both("set_difference", parity.differences, "SELECT * FROM df")
_add_both("set_intersection", lambda rows: parity.differences(rows).where("seen_by = 'both'").drop("seen_by"), "SELECT * EXCLUDE seen_by FROM df WHERE seen_by = 'both'")
_add_both("relative_counterpart", parity.relative_counterpart, "SELECT * FROM cp")
_add_both("mkdir_ancestor", parity.mkdir_ancestor, "SELECT * FROM md")
_add_both("parity_compare", parity.compare, "SELECT *, reason IS NOT NULL AS expected FROM cmp")
_add_both(
    "parity_counts",
    parity.counts,
    "SELECT pair_id, class, count(*) FILTER (seen_by IN ('first', 'both')) AS first, count(*) FILTER (seen_by IN ('second', 'both')) AS second, count(*) FILTER (seen_by = 'both') AS shared FROM df GROUP BY ALL",
)


def predicates(spark, d) -> DataFrame:
    """The scalar functions over commands, addresses and ports of every event."""
    e = bridge.events(spark, d)
    return e.select(
        "recording_id",
        "seq",
        net.is_unusual_port(F.col("port")).alias("unusual_port"),
        net.is_loopback(F.col("ip")).alias("loopback"),
        net.is_private(F.col("ip")).alias("private"),
        proc.pipes_download_to_shell(F.col("argv"), F.col("argv_truncated")).alias("pipes"),
        proc.shell_pipeline_tool(F.col("argv")).alias("tool"),
        proc.command_line(F.col("argv"), F.col("bin")).alias("command"),
    )


_add(
    "scalar_predicates",
    predicates,
    BASE
    + """SELECT recording_id, seq, coalesce(port NOT IN (0, 80, 443), false) AS unusual_port, coalesce(starts_with(ip, '127.') OR ip = '::1', false) AS loopback,
  coalesce(starts_with(ip, '10.') OR starts_with(ip, '192.168.') OR starts_with(ip, '169.254.'), false) AS private,
  script IS NOT NULL AND NOT argv_truncated AS pipes, CASE WHEN script IS NOT NULL THEN 'curl' END AS tool, command FROM p""",
)


def host_classes(spark, d) -> DataFrame:
    """Hosts of web pages by suffix: all label suffixes of each different host, joined with a small list."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    hosts = pages.select(F.lower(F.parse_url("url", F.lit("HOST"))).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    suffixes = spark.createDataFrame([("example", "example"), ("com", "com"), ("org", "org"), ("net", "net")], "suffix string, host_class string")
    rows = hosts.select("host", "pages", F.explode(net.label_suffixes(F.col("host"))).alias("suffix")).join(F.broadcast(suffixes), "suffix")
    best = rows.groupBy("host").agg(F.max("host_class").alias("host_class"))
    return hosts.join(best, "host", "left").select("host", "pages", F.coalesce("host_class", F.lit("other")).alias("host_class"))


_add(
    "host_class_join",
    host_classes,
    """SELECT host, pages, CASE WHEN ends_with(host, '.org') OR host = 'org' THEN 'org' WHEN ends_with(host, '.net') OR host = 'net' THEN 'net' WHEN ends_with(host, '.example') OR host = 'example' THEN 'example'
  WHEN ends_with(host, '.com') OR host = 'com' THEN 'com' ELSE 'other' END AS host_class
FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1)""",
)
