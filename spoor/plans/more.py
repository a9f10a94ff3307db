"""Queries for reviewers, stores and result trees, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spoor.catalog import CLASSES, NETWORK_TOOLS, caveats
from spoor.functions import paths, process, times
from spoor.operators import behavior, corpus, descriptors, legacy, lockfile, parity, review, rules
from spoor.plans import bridge
from spoor.plans.corpus import ARRIVALS, CAP, FD, HOUR, LOCK, RUNS, arrivals
from spoor.plans.parity import FACTS, sides
from spoor.plans.security import BASE, BEHAVIOR, CATALOG, SUFFIX, words
from spoor.plans.sources import _dropped
from spoor.scratch import materialize, shared_dir
from spoor.sources import folders, recordings
from spoor.streaming import live

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query(
    "absolute_time",
    """SELECT user_id AS recording_id, event_id, epoch_us(ts) AS absolute_us,
  format('{:02d}:{:02d}:{:02d}.{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, format('{:d}.{:03d}s', ms // 1000, ms % 1000) AS seconds
FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS ms FROM events)""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("recording_id"), "event_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us"))
    start = e.groupBy("recording_id").agg(F.min("us").alias("start"))
    wall = F.date_format(F.timestamp_micros("start"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = e.join(start, "recording_id").select("recording_id", "event_id", wall.alias("wall"), ((F.col("us") - F.col("start")) * 1000).alias("ts_ns"))
    return rows.select("recording_id", "event_id", F.unix_micros(times.absolute_time(F.col("wall"), F.col("ts_ns"))).alias("absolute_us"), times.clock(F.col("ts_ns")).alias("clock"), times.seconds(F.col("ts_ns")).alias("seconds"))


@query(
    "reason_text",
    """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'recording interrupted' WHEN 1 THEN 'exceeded ' || o_custkey || 's time limit' WHEN 2 THEN 'event cap of ' || o_custkey || ' reached; stream is truncated' WHEN 3 THEN o_custkey || ' unparseable trace lines'
  WHEN 4 THEN 'trace output truncated: d' || o_custkey WHEN 5 THEN 'recorder backend died: d' || o_custkey WHEN 6 THEN 'recorder backend failed to start: d' || o_custkey ELSE 'd' || o_custkey END AS reason FROM orders""",
)
def _(spark, d):
    return _reasons(spark, d).select("id", recordings.incomplete_reason(F.col("reason")).alias("reason"))


def _reasons(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("n"))
    tagged = lambda tag, key, text: F.to_json(F.struct(F.struct((F.concat(F.lit("d"), F.col("n").cast("string")) if text else F.col("n")).alias(key)).alias(tag)))
    kinds = [("timeout", "limit_secs", False), ("event_cap_reached", "cap", False), ("parse_errors", "count", False), ("trace_truncated", "detail", True), ("backend_died", "detail", True), ("backend_failed_to_start", "detail", True), ("other", "detail", True)]
    reason = F.when(F.col("id") % 8 == 0, "interrupted")
    for k, kind in enumerate(kinds, 1):
        reason = reason.when(F.col("id") % 8 == k, tagged(*kind))
    return o.select("id", reason.alias("reason"))


TECHNIQUE = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in review.TECHNIQUES.items()) + " END"


@query("attack_technique", BASE + f"SELECT recording_id, rule_id, subject, {TECHNIQUE} AS technique FROM f")
def _(spark, d):
    return rules.findings(bridge.events(spark, d)).select("recording_id", "rule_id", "subject", review.attack_technique(F.col("rule_id")).alias("technique"))


NAMES = """SELECT CAST(p_partkey AS BIGINT) AS line_no, CASE p_partkey % 7 WHEN 0 THEN '@scope/p' || p_size || '@1.0.' || p_partkey WHEN 1 THEN '  p' || p_size || '@2.0 ' WHEN 2 THEN '# ' || p_brand WHEN 3 THEN ' '
  WHEN 4 THEN p_brand WHEN 5 THEN 'p..' || p_size ELSE '@scope/q' || p_size END AS line FROM {part}"""


@query(
    "valid_package_name",
    f"""WITH l AS (SELECT line_no, trim(line) AS line FROM ({NAMES.replace('{part}', 'part')})), n AS (
  SELECT line_no, CASE WHEN instr(line[2:], '@') > 0 THEN line[:length(line) - instr(reverse(line), '@')] ELSE line END AS name FROM l WHERE line <> '' AND NOT starts_with(line, '#'))
SELECT name, min(line_no) AS line_no, NOT regexp_matches(name, '{review.NAME}') OR contains(name, '..') AS refused FROM n GROUP BY name""",
)
def _(spark, d):
    return review.valid_package_names(spark.sql(NAMES.replace("{part}", "{source}"), source=spark.read.parquet(f"{d}/part.parquet")))


def hook_text(h: str, k: int) -> str:
    return f"CASE o_orderkey % {k} WHEN 0 THEN 'node {h}.js' WHEN 1 THEN '  ' END"


SCRIPTS = ", ".join(f"{hook_text(h, k)} AS h_{h}" for h, k in zip(review.HOOKS, (3, 4, 5, 7), strict=True))


@query(
    "install_hooks",
    f"SELECT id, concat_ws(', ', {', '.join(f'''CASE WHEN trim(h_{h}) <> '' THEN '{h}' END''' for h in review.HOOKS)}) AS hooks FROM (SELECT o_orderkey AS id, {SCRIPTS} FROM orders)",
)
def _(spark, d):
    return _scripts(spark, d).select("id", F.array_join(review.install_hooks(F.col("scripts")), ", ").alias("hooks"))


def _scripts(spark, d):
    """Scripts of each order as a map that lacks the hooks it does not have, and has one that is no hook."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), *[F.expr(hook_text(h, k)).alias(h) for h, k in zip(review.HOOKS, (3, 4, 5, 7), strict=True)])
    entries = F.filter(F.array(F.struct(F.lit("test").alias("k"), F.lit("x").alias("v")), *[F.struct(F.lit(h).alias("k"), F.col(h).alias("v")) for h in review.HOOKS]), lambda e: e["v"].isNotNull())
    return o.select("id", F.map_from_entries(entries).alias("scripts"))


DECLARED = """WITH r AS (
  SELECT 'c' || CAST(o_custkey AS VARCHAR) AS package, CAST(o_orderkey AS VARCHAR) AS version, o_orderkey % 10 AS events FROM orders WHERE o_orderstatus = 'F'
), p AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS package, CAST(o_orderkey AS VARCHAR) AS version, CASE WHEN o_orderkey % 4 = 0 THEN 'install, prepare' WHEN o_orderkey % 4 = 1 THEN 'install' ELSE '' END AS declared FROM orders WHERE o_orderkey % 9 <> 0)
SELECT package, version, CASE WHEN declared <> '' THEN 'declares_install_script' ELSE 'no_declared_install_script' END AS kind, CASE WHEN declared <> '' THEN 20 ELSE 10 END AS weight, declared, events
FROM r JOIN p USING (package, version) WHERE declared <> '' OR events > 0"""


@query("declared_vs_recorded", DECLARED)
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("package"), F.col("o_orderkey").cast("string").alias("version"), "o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    declares = F.when(k % 4 == 0, F.array(F.lit("install"), F.lit("prepare"))).when(k % 4 == 1, F.array(F.lit("install"))).otherwise(F.array().cast("array<string>"))
    usable = o.where("o_orderstatus = 'F'").select("package", "version", (k % 10).alias("events"))
    return review.declared_vs_recorded(usable, o.where(k % 9 != 0).select("package", "version", declares.alias("declares")))


@query("flatten_added", BEHAVIOR + "SELECT package, before_version AS before, after_version AS after, class, summary FROM vd WHERE change = 'added'")
def _(spark, d):
    return review.flatten_added(review.added_as_json(behavior.version_diff(bridge.events(spark, d))))


@query("union_streams", BASE + "SELECT recording_id, seq, backend, op, CASE WHEN backend = 'strace' THEN qname END AS qname, path FROM p")
def _(spark, d):
    e = bridge.events(spark, d).select("recording_id", "seq", "backend", "op", "qname", "path")
    return recordings.union_streams(e.where("backend = 'strace'"), e.where("backend = 'aya'").drop("qname"))


LEGACY = (
    BASE
    + f""", z AS (
  SELECT *, coalesce(ok, true) AS worked, coalesce(op = 'fs_write' AND kind = 'chmod', false) AS is_chmod, lower(regexp_replace(qname, '\\.$', '')) AS lhost,
    CASE WHEN path IS NULL OR NOT starts_with(path, '/') THEN 'unresolved' WHEN placement IN ('project', 'cache', 'home', 'tmp') THEN placement
      WHEN {' OR '.join(f"starts_with(path, '{b}')" for b in legacy.BENIGN)} THEN 'runtime' WHEN starts_with(path, '/tmp/') OR starts_with(path, '/var/tmp/') THEN 'tmp' ELSE 'outside' END AS lzone
  FROM p
), lf AS (
  SELECT recording_id, 'write_outside_expected_dirs' AS rule, 'critical' AS severity, path AS subject FROM z WHERE op = 'fs_write' AND NOT is_chmod AND worked AND lzone = 'outside'
  UNION ALL SELECT recording_id, CASE WHEN regexp_matches(lhost, '{legacy.BINARY_HOSTS}') THEN 'install_downloads_from_non_registry_host' ELSE 'dns_non_registry_host' END, CASE WHEN regexp_matches(lhost, '{legacy.BINARY_HOSTS}') THEN 'medium' ELSE 'high' END, lhost
    FROM z WHERE op = 'dns_query' AND contains(lhost, '.') AND NOT regexp_matches(lhost, '(^|\\.)(npmjs\\.org|npmjs\\.com|yarnpkg\\.com)$')
  UNION ALL SELECT recording_id, CASE WHEN port IN (80, 443) THEN 'network_connect_external' ELSE 'network_connect_unusual_port' END, CASE WHEN port IN (80, 443) THEN 'low' ELSE 'high' END, ip || ':' || port FROM z WHERE op = 'net_connect' AND worked AND NOT loopback AND NOT private
  UNION ALL SELECT recording_id, CASE WHEN worked THEN 'credential_path_access' ELSE 'credential_path_access_attempted' END, CASE WHEN worked THEN 'high' ELSE 'medium' END, path FROM z WHERE op IN ('fs_read', 'fs_write') AND NOT is_chmod AND regexp_matches(path, '{legacy.CREDENTIALS}')
  UNION ALL SELECT recording_id, 'npmrc_access', 'low', path FROM z WHERE op IN ('fs_read', 'fs_write') AND NOT is_chmod AND worked AND path LIKE '%/.npmrc'
  UNION ALL SELECT recording_id, CASE WHEN script IS NOT NULL THEN 'download_piped_to_shell' WHEN prog IN ({words(NETWORK_TOOLS)}) THEN 'spawned_network_tool' ELSE 'spawned_unexpected_binary' END,
      CASE WHEN script IS NOT NULL THEN 'critical' WHEN prog IN ({words(NETWORK_TOOLS)}) THEN 'high' ELSE 'medium' END, CASE WHEN script IS NOT NULL THEN command ELSE prog END
    FROM z WHERE op = 'proc_spawn' AND worked AND (script IS NOT NULL OR prog NOT IN ({words(legacy.EXPECTED)}))
  UNION ALL SELECT recording_id, 'chmod_exec_outside_project', 'high', path FROM z WHERE is_chmod AND worked AND regexp_matches(mode, '[751]') AND lzone = 'outside'
), lg AS (SELECT recording_id, rule, severity, subject, CASE WHEN rule LIKE 'dns_%' OR rule LIKE 'network_%' OR rule LIKE 'install_%' THEN 1 ELSE count(*) END AS occurrences FROM lf GROUP BY recording_id, rule, severity, subject
), lc AS (
  SELECT rc.recording_id, rc.package, rc.is_partial, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
    count(*) FILTER (severity <> 'low' AND rule NOT IN ({words(legacy.NO_CANDIDATES)})) AS candidates
  FROM rc LEFT JOIN lg USING (recording_id) GROUP BY ALL
), le AS (SELECT *, critical * 40 + high * 15 + medium * 5 + low AS raw FROM lc
), pk AS (SELECT package, bool_or(is_partial) AS is_partial, max(least(raw, 100)) AS score, CASE WHEN max(recording_id) % 3 = 0 THEN 1 ELSE 0 END AS exit_code FROM le GROUP BY package
), cd AS (SELECT DISTINCT package, rule AS rule_id, subject FROM lg JOIN rc USING (recording_id) WHERE severity <> 'low' AND rule NOT IN ({words(legacy.NO_CANDIDATES)}))
"""
)


@query("legacy_findings", LEGACY + "SELECT * FROM lg")
def _(spark, d):
    return legacy.legacy_findings(bridge.events(spark, d))


#: What a registry says of each version, made from its number.
TOLD = "package, version, CAST(regexp_extract(version, '^1[.]([0-9]+)', 1) AS INT) AS k, published_at, unpublished"


@query(
    "package_versions",
    f"""WITH p AS (SELECT {TOLD} FROM ({bridge.duckdb(bridge.PUBLISHED)})), v AS (SELECT *, CASE WHEN k % 13 = 5 THEN 'never' ELSE published_at || 'T00:00:00.000Z' END AS stamp FROM p)
SELECT package, version, stamp AS published_at, CASE WHEN contains(version, '-') THEN 'prerelease' WHEN unpublished THEN 'unpublished' WHEN stamp = 'never' THEN 'no_timestamp' END AS excluded,
  CASE WHEN NOT unpublished THEN CASE WHEN k % 4 = 0 THEN 'install,postinstall' ELSE '' END END AS install_scripts, CASE WHEN NOT unpublished AND k % 6 = 0 THEN 'old' END AS deprecated,
  CASE WHEN NOT unpublished THEN k * 10::BIGINT END AS unpacked_bytes, CASE WHEN NOT unpublished AND k % 3 > 0 THEN 'sha512-' || k END AS integrity FROM v""",
)
def _(spark, d):
    """Documents as a registry gives them, written from the published versions and taken apart again."""
    c = F.col
    rows = bridge.published(spark, d).selectExpr(*[x.strip() for x in ("package", "version", "CAST(regexp_extract(version, '^1[.]([0-9]+)', 1) AS INT) AS k", "published_at", "unpublished")])
    stamp = F.when(c("k") % 13 == 5, "never").otherwise(F.concat("published_at", F.lit("T00:00:00.000Z")))
    scripts = F.when(c("k") % 4 == 0, F.struct(F.lit("node x").alias("install"), F.lit("y").alias("postinstall"), F.lit("t").alias("test"))).when(c("k") % 4 == 1, F.struct(F.lit(" ").alias("install"), F.lit(None).cast("string").alias("postinstall"), F.lit("t").alias("test")))
    dist = F.struct((c("k") * 10).alias("unpackedSize"), F.when(c("k") % 3 > 0, F.concat(F.lit("sha512-"), c("k").cast("string"))).alias("integrity"))
    manifest = F.struct(scripts.alias("scripts"), F.when(c("k") % 6 == 0, "old").alias("deprecated"), dist.alias("dist"))
    held = rows.select("package", F.struct("version", stamp.alias("stamp")).alias("t"), F.when(~c("unpublished"), F.struct("version", manifest.alias("m"))).alias("v"))
    times = F.concat(F.collect_list("t"), F.array(F.struct(F.lit("created").alias("version"), F.lit("2000-01-01").alias("stamp"))))
    only_held = F.array(F.struct(F.lit("9.9.9").alias("version"), F.first("v.m", ignorenulls=True).alias("m")))
    documents = held.groupBy("package").agg(F.to_json(F.struct(F.map_from_entries(times).alias("time"), F.map_from_entries(F.concat(F.collect_list("v"), only_held)).alias("versions"))).alias("document"))
    return corpus.package_versions(documents).withColumn("install_scripts", F.array_join("install_scripts", ","))


@query("behavior_sketches", BEHAVIOR + "SELECT package, count(DISTINCT summary) AS distinct_behaviors, true AS near FROM bs GROUP BY package")
def _(spark, d):
    """Exact numbers of different behaviours by package, and whether those of the united sketches are within five percent, or one."""
    e = bridge.events(spark, d)
    exact = behavior.profile(e).groupBy("package").agg(F.countDistinct(behavior.behavior_summary()).alias("distinct_behaviors"))
    about = behavior.distinct_of(behavior.sketches(e), "package").withColumnRenamed("distinct_behaviors", "about")
    near = F.abs(F.col("about") - F.col("distinct_behaviors")) <= F.greatest(F.lit(1), 0.05 * F.col("distinct_behaviors"))
    return exact.join(about, "package").select("package", "distinct_behaviors", near.alias("near"))


@query("ecosystem_changes", "SELECT repo, CASE WHEN repo % 5 = 0 THEN NULL WHEN repo % 3 = 0 THEN 'pnpm' ELSE 'npm' END AS before, 'npm' AS after, repo % 5 <> 0 AND repo % 3 = 0 AS ecosystem_changed FROM (SELECT DISTINCT l_suppkey AS repo FROM lineitem)")
def _(spark, d):
    """Repositories of which some come from another package manager and some had no lockfile."""
    repos = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("repo")).distinct()
    after = repos.select("repo", F.lit("after").alias("side"), F.lit('{"lockfileVersion": 3, "packages": {}}').alias("content"))
    before = repos.where("repo % 5 <> 0").select("repo", F.lit("before").alias("side"), F.when(F.col("repo") % 3 == 0, "lockfileVersion: '6.0'\n\npackages:\n").otherwise('{"lockfileVersion": 2}').alias("content"))
    return lockfile.ecosystem_changes(after.unionByName(before))


#: Command lines on both sides of the first rule set's pipe rule, and whether it finds them.
PIPES = [
    (["fish", "-c", "curl u | sh"], True), (["sh", "-c", "curl u | shasum -a 256"], False), (["sh", "-c", "my-curl u | sh"], True), (["/bin/zsh", "-e", "-c", "fetch u |sudo  python3.11 -"], True),
    (["python", "-c", "curl u | sh"], False), (["sh", "-c", "scurl u | sh"], False), (["bash", "-c"], False), (["tcsh", "-c", "wget u | node app"], True),
]
PIPED = f"""SELECT recording_id, [{words(" ".join(a) for a, _ in PIPES)}][seq % 8 + 1] AS command, [{", ".join(str(p).lower() for _, p in PIPES)}][seq % 8 + 1] AS piped FROM p WHERE op = 'proc_spawn' AND coalesce(ok, true)"""


@query("legacy_pipes", BASE + f"SELECT recording_id, CASE WHEN piped THEN 'download_piped_to_shell' ELSE 'spawned_unexpected_binary' END AS rule, CASE WHEN piped THEN 'critical' ELSE 'medium' END AS severity, CASE WHEN piped THEN command ELSE 'x' END AS subject, count(*) AS occurrences FROM ({PIPED}) GROUP BY ALL")
def _(spark, d):
    spawns = bridge.events(spark, d).where("op = 'proc_spawn'")
    lines = F.array(*[F.array(*map(F.lit, a)) for a, _ in PIPES])
    return legacy.legacy_findings(spawns.withColumns({"argv": F.get(lines, (F.col("seq") % 8).cast("int")), "bin": F.lit("/opt/x")}))


@query("legacy_classify", LEGACY + "SELECT *, least(raw, 100) AS score FROM le")
def _(spark, d):
    return legacy.legacy_classify(bridge.events(spark, d))


def _candidates(spark, d):
    """Packages with their worst recording, and their candidates."""
    e = bridge.events(spark, d)
    scored = materialize(legacy.legacy_classify(e), "scored")
    packages = scored.groupBy("package").agg(F.max("is_partial").alias("is_partial"), F.max("score").alias("score"), F.when(F.max("recording_id") % 3 == 0, 1).otherwise(0).alias("exit_code"))
    wanted = legacy.legacy_findings(e).where((F.col("severity") != "low") & ~F.col("rule").isin(legacy.NO_CANDIDATES))
    return packages, wanted.join(scored.select("recording_id", "package"), "recording_id").select("package", F.col("rule").alias("rule_id"), "subject").distinct()


@query(
    "candidate_totals",
    LEGACY
    + """SELECT (SELECT count(*) FROM pk) AS packages_recorded, (SELECT count(*) FROM pk WHERE NOT is_partial) AS recordings_complete, (SELECT count(*) FROM pk WHERE is_partial) AS recordings_partial, (SELECT count(*) FROM pk WHERE exit_code <> 0) AS installs_nonzero_exit,
  count(*) FILTER (NOT is_partial) AS candidates_complete, count(*) FILTER (is_partial) AS candidates_partial, count(DISTINCT package || '|' || rule_id) FILTER (NOT is_partial) AS distinct_pairs, count(DISTINCT package) FILTER (NOT is_partial) AS packages_with_candidates,
  count(DISTINCT package || '|' || rule_id) FILTER (NOT is_partial) >= 10 AS meets_target FROM cd JOIN pk USING (package)""",
)
def _(spark, d):
    packages, candidates = _candidates(spark, d)
    return review.candidate_totals(candidates, packages)


@query("candidates_by_rule", LEGACY + "SELECT rule_id, count(*) AS candidates FROM cd JOIN pk USING (package) WHERE NOT is_partial GROUP BY rule_id")
def _(spark, d):
    packages, candidates = _candidates(spark, d)
    return review.candidates_by_rule(candidates, packages)


@query("rank_packages_by_score", LEGACY + "SELECT package, score, row_number() OVER (ORDER BY score DESC, package) AS place FROM pk")
def _(spark, d):
    return review.rank_packages_by_score(_candidates(spark, d)[0])


@query(
    "download_claims",
    """SELECT count(*) AS packages_in_list, count(n) AS packages_with_counts, min(n) AS min_weekly_downloads, count(*) - count(n) AS packages_without_counts,
  count(n) || ' packages, each with at least ' || min(n) || ' weekly downloads' AS claim FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) END AS n FROM customer)""",
)
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return review.download_claims(c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 != 0, F.floor(F.abs("c_acctbal")).cast("long")).alias("weekly_downloads")))


@query(
    "stream_facts",
    BASE
    + """SELECT recording_id, strftime(to_timestamp(1700000000 + recording_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, any_value(agent_version) AS agent_version, arg_min(backend, seq) AS backend, count(*) AS events,
  bool_or(complete AND has_end) AS complete FROM p GROUP BY recording_id""",
)
def _(spark, d):
    events, _ = recordings.read_recordings(spark, _dropped(spark, d, packed=True), "quarantine", packed=True)
    return recordings.stream_facts(events).withColumn("recording_id", F.col("recording_id").cast("long")).drop("incomplete_reasons")


@query(
    "snapshot_verify",
    BASE
    + """SELECT package, version, CASE WHEN recording_id % 7 NOT IN (3, 4, 5, 6) THEN observations END AS observations,
  CASE recording_id % 7 WHEN 3 THEN 'malformed digest' WHEN 4 THEN 'blob missing' WHEN 5 THEN 'content does not match its digest' WHEN 6 THEN 'line 1: malformed line' END AS error FROM rc""",
)
def _(spark, d):
    return _verified(spark, d).drop("digest")


def _verified(spark, d):
    """The written recordings as a store; of seven entries one has a bad digest, one no blob, one another content, one no stream."""
    about = bridge.events(spark, d).groupBy("recording_id").agg(F.max("package").alias("package"), F.max("version").alias("version"))
    files = recordings.read_files(spark, _dropped(spark, d)).withColumn("recording_id", F.col("recording_id").cast("long"))
    part = F.col("recording_id") % 7
    content = F.when(part == 6, F.concat(F.lit("no stream "), F.col("recording_id").cast("string"))).otherwise(F.col("content"))
    rows = files.join(about, "recording_id").withColumn("content", content).withColumn("digest", F.sha2("content", 256))
    rows = materialize(rows, "store")
    index = rows.select("package", "version", F.when(part == 3, F.upper("digest")).otherwise(F.col("digest")).alias("digest"))
    blobs = rows.where(part != 4).select("digest", F.when(part == 5, F.concat("content", F.lit(" "))).otherwise(F.col("content")).alias("content"))
    return corpus.snapshot_verify(index, blobs.dropDuplicates(["digest"]))


@query(
    "corpus_report",
    BEHAVIOR
    + """, e AS (SELECT * FROM rc WHERE recording_id % 7 NOT IN (3, 4, 5, 6)), k AS (SELECT package, count(*) AS n FROM e GROUP BY package), o AS (SELECT count(*) AS observations, count(DISTINCT summary) AS different FROM bs WHERE recording_id % 7 NOT IN (3, 4, 5, 6)
), t AS (SELECT (SELECT count(*) FROM rc) AS entries, (SELECT count(*) FROM e) AS readable, (SELECT count(*) FROM k) AS packages, (SELECT count(*) FROM k WHERE n > 1) AS packages_with_history, (SELECT CAST(sum(n - 1) AS BIGINT) FROM k) AS diffable_pairs,
  (SELECT count(*) FROM (SELECT recording_id, bool_or(complete) AS complete FROM b GROUP BY 1) WHERE NOT complete AND recording_id % 7 NOT IN (3, 4, 5, 6)) AS incomplete,
  (SELECT count(*) FROM p WHERE placement = 'unresolvable' AND (op = 'fs_read' OR op = 'fs_write' AND NOT failed) AND recording_id % 7 NOT IN (3, 4, 5, 6)) AS unresolved_paths)
SELECT entries, readable, entries - readable AS unreadable, packages, packages_with_history, diffable_pairs, incomplete, unresolved_paths, entries = readable AND incomplete = 0 AS intact,
  readable || ' recordings of ' || packages || ' packages, ' || diffable_pairs || ' version pairs comparable, ' || observations || ' behavior observations of ' || different || ' distinct behaviors' AS claim FROM t, o""",
)
def _(spark, d):
    return behavior.corpus_report(bridge.events(spark, d), materialize(_verified(spark, d), "verified"))




RESULT = "SELECT package, version, observations AS events, NOT is_partial AS complete, recording_id % 13 = 12 AS broken, recording_id % 11 = 10 AS nameless FROM rc"


def _result_tree(spark, d):
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    rows = bridge.events(spark, d).groupBy("recording_id").agg(F.max("package").alias("package"), F.max("version").alias("version"), F.count(F.lit(1)).alias("events"), F.max(F.col("complete") & F.col("has_end")).alias("complete"))
    rec = F.col("recording_id")
    text = F.to_json(F.struct("package", F.when(rec % 11 != 10, F.col("version")).alias("version"), "events", "complete"))
    text = F.when(rec % 13 == 12, F.substring(text, F.lit(1), F.char_length(text) - 3)).otherwise(text)
    folders.write_tree(rows.select("package", rec.alias("run"), text.alias("value")), path, ["package", "run"], "value")
    return path


@query("read_run_results", BASE + f"SELECT package, version, events, complete FROM ({RESULT}) WHERE NOT broken AND NOT nameless")
def _(spark, d):
    return recordings.read_run_results(spark, _result_tree(spark, d), "part-*")[0].select("package", "version", "events", "complete")


@query("malformed_run_results", BASE + f"SELECT CASE WHEN broken THEN 'not valid JSON' ELSE 'missing package or version' END AS error, count(*) AS files FROM ({RESULT}) WHERE broken OR nameless GROUP BY 1")
def _(spark, d):
    return recordings.read_run_results(spark, _result_tree(spark, d), "part-*")[1].groupBy("error").agg(F.count(F.lit(1)).alias("files"))


@query(
    "stateful_write_volume",
    FD
    + """, g AS (SELECT *, count(*) FILTER (act <> 'write') OVER (PARTITION BY recording_id, pid, fd ORDER BY seq) AS life FROM a
), o AS (SELECT *, first_value(path) OVER (PARTITION BY recording_id, pid, fd, life ORDER BY seq) AS target FROM g
)
SELECT recording_id, pid, fd, target AS path, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS writes, max(us) AS last_us FROM o WHERE act = 'write' AND target IS NOT NULL GROUP BY recording_id, pid, fd, life, target
UNION ALL SELECT recording_id, pid, fd, NULL, bytes, 1, us FROM o WHERE act = 'write' AND target IS NULL""",
)
def _(spark, d):
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    activity = bridge.fd_activity(spark, d).select("recording_id", "pid", "fd", "seq", "us", "act", "path", "bytes")
    last = activity.groupBy("recording_id", "pid", "fd").agg((F.max("seq") + 1).alias("seq"), F.max("us").alias("us")).withColumn("act", F.lit("end"))
    activity.unionByName(last, allowMissingColumns=True).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(activity.schema).parquet(f"{folder}/in")
    return live.run_once(live.stateful_write_volume(stream), "append", folder)


@query(
    "path_predicates",
    BASE
    + """SELECT recording_id, seq, coalesce(contains(path, '/.ssh/') OR contains(path, '/.npmrc') OR starts_with(split_part(path, '/', -1), '.env'), false) AS of_interest, coalesce(kind IN ('open', 'write'), false) AS write_intent,
  coalesce(regexp_matches(command, '(^|[^A-Za-z0-9_-])curl($|[^A-Za-z0-9_-])'), false) AS says_curl FROM p""",
)
def _(spark, d):
    e = bridge.events(spark, d)
    flags = F.when(F.col("kind") == "open", "O_WRONLY|O_CLOEXEC").when(F.col("kind") == "write", "O_CREAT|O_TRUNC").when(F.col("op") == "fs_read", "O_RDONLY|O_CLOEXEC")
    word = F.coalesce(process.contains_word(process.command_line(F.col("argv"), F.col("bin")), "curl"), F.lit(False))
    return e.select("recording_id", "seq", paths.read_of_interest(F.col("path")).alias("of_interest"), paths.has_write_intent(flags).alias("write_intent"), word.alias("says_curl"))


@query(
    "coverage_table",
    BASE
    + f"""SELECT recording_id, backend, CASE WHEN backend = 'aya' THEN 'credential reads, DNS queries' ELSE '' END AS blind_spots, CASE WHEN backend = 'aya' THEN '{', '.join(c for c in CLASSES if c not in ('credential reads', 'DNS queries'))}' ELSE '{', '.join(CLASSES)}' END AS qualifications,
  CASE WHEN backend = 'aya' THEN 'Not checked by the aya backend: credential reads, DNS queries. Absence of these findings is not evidence they did not happen.' END AS caveat FROM rc""",
)
def _(spark, d):
    recordings_ = bridge.events(spark, d).groupBy("recording_id").agg(F.min_by("backend", "seq").alias("backend"))
    return recordings_.join(F.broadcast(caveats(spark)), "backend")


@query("catalog_host_classes", BASE + f"SELECT recording_id, seq, qname AS host, CASE WHEN host IN ({words(CATALOG.registry_hosts)}) OR {SUFFIX('host', CATALOG.registry_suffixes)} THEN 'registry' WHEN {SUFFIX('host', CATALOG.binary_distribution_suffixes)} THEN 'binary_distribution' ELSE 'other' END AS host_class FROM p WHERE qname IS NOT NULL")
def _(spark, d):
    return rules.host_classes(bridge.events(spark, d).where("qname is not null").select("recording_id", "seq", F.col("qname").alias("host")))


@query(
    "reorder_window",
    ARRIVALS
    + f""", n AS (SELECT *, max(us) OVER (PARTITION BY recording_id ORDER BY arrival) AS newest FROM a
), r AS (SELECT x.recording_id, x.arrival, x.us, min(greatest(n.arrival, x.arrival)) AS released_at FROM a x JOIN n ON n.recording_id = x.recording_id AND n.newest >= x.us + {HOUR} GROUP BY ALL
), l AS (SELECT a.recording_id, a.arrival, max(r.us) AS last_released FROM a JOIN r ON r.recording_id = a.recording_id AND r.released_at < a.arrival GROUP BY ALL)
SELECT a.recording_id, a.us, a.arrival, coalesce(a.us < last_released, false) AS late FROM a LEFT JOIN l ON l.recording_id = a.recording_id AND l.arrival = a.arrival""",
)
def _(spark, d):
    """The stream's twin of late_events; a row without a time ends each recording."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = arrivals(spark, d).select("recording_id", "us", "arrival")
    ends = rows.groupBy("recording_id").agg((F.max("arrival") + 1).alias("arrival")).withColumn("us", F.lit(None).cast("long"))
    rows.unionByName(ends).write.parquet(f"{folder}/in")
    return live.run_once(live.reorder_window(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), HOUR), "append", folder)


@query("capped_events", ARRIVALS + f", n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY us, arrival) AS n, count(*) OVER (PARTITION BY recording_id) > {CAP} AS is_partial FROM a) SELECT recording_id, arrival, us, is_partial FROM n WHERE n <= {CAP}")
def _(spark, d):
    return descriptors.capped_events(arrivals(spark, d), CAP)


@query("lock_recordable", LOCK + "SELECT repo, name, version, CAST(row_number() OVER (PARTITION BY repo ORDER BY name, version) AS INTEGER) AS place FROM (SELECT DISTINCT repo, name, version FROM ch WHERE introduces_code)")
def _(spark, d):
    return lockfile.recordable(lockfile.changes(bridge.lock_packages(spark, d)))


PASSES = "SELECT pair_id, count(*) FILTER (NOT expected) AS unexpected, count(*) FILTER (NOT expected) = 0 AND NOT bool_or(partial) AS passed FROM (SELECT x.pair_id, coalesce(reason IS NOT NULL, true) AS expected, partial FROM (SELECT pair_id, bool_or(partial) AS partial FROM qp GROUP BY pair_id) x LEFT JOIN cmp ON cmp.pair_id = x.pair_id) GROUP BY pair_id"


@query("parity_passes", FACTS + ", qp AS (SELECT pair_id, NOT (complete AND has_end) AS partial FROM q) SELECT * FROM (" + PASSES + ")")
def _(spark, d):
    events = bridge.events(spark, d)
    pairs = behavior.version_pairs(behavior.recordings_of(events)).withColumn("pair_id", F.concat("package", F.lit(":"), "before_version"))
    partial = events.where("not (complete and has_end)").select("recording_id").distinct()
    of = pairs.select("pair_id", F.explode(F.array("before_id", "after_id")).alias("recording_id")).join(partial, "recording_id").select("pair_id")
    return parity.passes(sides(spark, d), of)


@query("registry_excess", RUNS + "SELECT count(*) FILTER (complete) AS complete, count(*) FILTER (complete AND NOT pushed) AS not_pushed, greatest((SELECT count(*) FROM r WHERE pushed) - count(*) FILTER (complete), 0) AS excess FROM best")
def _(spark, d):
    results = bridge.run_results(spark, d)
    return corpus.registry_excess(results, results.where("pushed").count())


@query("plan_counts", RUNS + "SELECT count(*) AS planned, count(*) FILTER (done) AS skipped, count(*) FILTER (NOT done) AS pending FROM (SELECT EXISTS (SELECT 1 FROM r WHERE complete AND r.package = rv.package AND '1.' || r.version = rv.version) AS done FROM rv WHERE n <= 5)")
def _(spark, d):
    done = bridge.run_results(spark, d).withColumn("version", F.concat(F.lit("1."), "version"))
    return corpus.plan_counts(corpus.recent_versions(bridge.published(spark, d)), done)
