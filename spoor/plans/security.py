"""Queries over recordings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.catalog import CLASS_OF_KIND, Catalog
from spoor.operators import behavior, rules
from spoor.plans import bridge
from spoor.scratch import materialize

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def words(values):
    return ", ".join(f"'{v}'" for v in values)


CATALOG = Catalog()
WITHIN = "(rtrim({z}, '/') <> '' AND (path = rtrim({z}, '/') OR starts_with(path, rtrim({z}, '/') || '/')))"
within = lambda z: WITHIN.replace("{z}", z)
SUFFIX = lambda host, suffixes: "(" + " OR ".join(f"{host} = '{s.lstrip('.')}' OR {host} LIKE '%.{s.lstrip('.')}'" for s in suffixes) + ")"

#: Events, their place, the kind of rule that asks about them.
BASE = f"""
WITH b AS ({bridge.duckdb(bridge.EVENTS)}
), p AS (
  SELECT *, CASE WHEN path IS NULL THEN NULL WHEN origin = 'unresolved' OR NOT starts_with(path, '/') THEN 'unresolvable'
      WHEN regexp_matches(path, '^(/proc|/sys|/dev|/run|/var/run)(/|$)') THEN 'runtime'
      WHEN {within('zone_project')} THEN 'project' WHEN {within('zone_cache')} THEN 'cache' WHEN {within('zone_home')} THEN 'home'
      WHEN {within('zone_tmp')} THEN 'tmp' WHEN {within('zone_extra')} THEN 'declared' ELSE 'outside' END AS placement,
    coalesce(NOT ok, false) AS failed, lower(rtrim(qname, '.')) AS host, split_part(bin, '/', -1) AS prog,
    CASE WHEN script IS NOT NULL THEN 'sh -c ' || script ELSE coalesce(bin, '') END AS command, ip || coalesce(':' || port, '') AS address
  FROM b
), h0 AS (
  SELECT *, CASE op
    WHEN 'fs_write' THEN CASE WHEN placement = 'outside' AND NOT failed THEN CASE WHEN kind = 'chmod' AND mode = '0755' THEN 'chmod_executable_outside_zones' ELSE 'write_outside_zones' END END
    WHEN 'fs_read' THEN CASE WHEN path LIKE '%/.npmrc' OR path LIKE '%/.yarnrc' THEN 'npmrc_read'
        WHEN split_part(path, '/', -1) IN ({words(CATALOG.credential_filenames)}) OR starts_with(split_part(path, '/', -1), '.env') OR {' OR '.join(f"contains(path, '{x}')" for x in CATALOG.credential_paths)}
        THEN CASE WHEN failed THEN 'credential_read_failed' ELSE 'credential_read' END END
    WHEN 'net_connect' THEN CASE WHEN ip IS NOT NULL AND NOT loopback AND NOT private AND NOT failed THEN CASE WHEN port NOT IN (0, 80, 443) THEN 'connect_unusual_port' ELSE 'connect_external' END END
    WHEN 'dns_query' THEN CASE WHEN host IN ({words(CATALOG.registry_hosts)}) OR {SUFFIX('host', CATALOG.registry_suffixes)} OR NOT contains(qname, '.') THEN NULL
        WHEN {SUFFIX('host', CATALOG.binary_distribution_suffixes)} THEN 'dns_binary_distribution' ELSE 'dns_outside_registry' END
    WHEN 'proc_spawn' THEN CASE WHEN script LIKE '%curl%|%sh%' AND NOT argv_truncated THEN 'download_piped_to_shell'
        WHEN prog IN ({words(CATALOG.network_tools)}) THEN 'spawn_network_tool' WHEN prog NOT IN ({words(CATALOG.expected_spawns)}) THEN 'spawn_unexpected' END
    END AS hit
  FROM p
), h AS (
  SELECT recording_id, seq, ts_ns, pid, op, backend, hit,
    CASE WHEN op IN ('fs_write', 'fs_read') THEN path WHEN op = 'net_connect' THEN address WHEN op = 'dns_query' THEN qname WHEN hit = 'download_piped_to_shell' THEN command ELSE prog END AS subject,
    CASE WHEN hit = 'chmod_executable_outside_zones' THEN 'chmod ' || mode || ' ' || path
      WHEN op = 'fs_write' THEN upper(kind[1]) || kind[2:] || coalesce(' ' || bytes || ' bytes', '')
      WHEN hit = 'npmrc_read' THEN 'read package manager config' WHEN hit = 'credential_read_failed' THEN 'failed: ' || coalesce(error, 'unknown error') WHEN op = 'fs_read' THEN 'read succeeded'
      WHEN op = 'net_connect' THEN 'connected to ' || address WHEN op = 'dns_query' THEN 'resolved ' || qname ELSE command END AS detail
  FROM h0 WHERE hit IS NOT NULL
), rule(kind, rule_id, severity, sev_rank, class, title) AS (VALUES {', '.join(f"('{r.kind}', '{r.id}', '{r.severity}', {['critical', 'high', 'medium', 'low'].index(r.severity)}, '{c}', '{r.title}')" for r, c in ((r, CLASS_OF_KIND[r.kind]) for r in CATALOG.rules))}
), m AS (
  SELECT h.*, rule.* FROM h JOIN rule ON h.hit = rule.kind WHERE NOT (backend = 'aya' AND class IN ('credential reads', 'DNS queries'))
), f AS (
  SELECT recording_id, rule_id, subject, any_value(severity) AS severity, any_value(sev_rank) AS sev_rank, any_value(title) || ': ' || subject AS title, count(*) AS occurrences,
    array_to_string(list_slice(list(seq || '=' || detail ORDER BY seq), 1, 5), '; ') AS evidence
  FROM m GROUP BY recording_id, rule_id, subject
), fo AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY sev_rank, occurrences DESC, rule_id, subject) AS place FROM f
), rc AS (
  SELECT recording_id, any_value(package) AS package, any_value(version) AS version, arg_min(backend, seq) AS backend, count(*) AS observations,
    count(*) FILTER (op = 'fs_write' AND placement = 'unresolvable') AS unresolved,
    count(*) FILTER (op = 'fs_write') AS n_fs_write, count(*) FILTER (op = 'fs_read') AS n_fs_read, count(*) FILTER (op = 'net_connect') AS n_net_connect,
    count(*) FILTER (op = 'dns_query') AS n_dns_query, count(*) FILTER (op = 'proc_spawn') AS n_proc_spawn, NOT bool_or(complete AND has_end) AS is_partial, bool_or(has_end) AS has_end
  FROM p GROUP BY recording_id
), s AS (
  SELECT rc.recording_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
    CAST(coalesce(sum(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 ELSE 0 END), 0) AS BIGINT) AS raw
  FROM rc LEFT JOIN f USING (recording_id) GROUP BY rc.recording_id
), a AS (
  SELECT rc.*, critical, high, medium, low, raw, least(raw, 100) AS value, raw > 100 AS was_capped,
    CASE WHEN is_partial THEN 'partial' WHEN raw > 0 THEN 'findings' WHEN backend = 'aya' OR unresolved > 0 OR observations = 0 THEN 'clean_with_caveat' ELSE 'clean' END AS verdict,
    least(raw, 100) || ' / 100' || CASE WHEN raw > 100 THEN ' (raw ' || raw || ')' ELSE '' END AS score_text
  FROM rc JOIN s USING (recording_id)
)
"""


def events(spark, d):
    return bridge.events(spark, d)


@query("bridge_events", bridge.duckdb(bridge.EVENTS))
def _(spark, d):
    return bridge.bridge_events(spark, d)


@query("evaluate", BASE + "SELECT recording_id, package, version, backend, observations, unresolved, critical, high, medium, low, raw, value, was_capped, is_partial, verdict, score_text FROM a")
def evaluate(spark, d):
    return rules.evaluate(events(spark, d))


@query("placement", BASE + "SELECT recording_id, seq, path, placement FROM p WHERE path IS NOT NULL")
def _(spark, d):
    return rules.placed(events(spark, d)).where("path is not null").select("recording_id", "seq", "path", "placement")


def _hits_of(op):
    @query(f"eval_{op[0]}", BASE + f"SELECT recording_id, seq, hit, subject, detail FROM h WHERE op = '{op[1]}'")
    def run(spark, d):
        return rules.hits(events(spark, d).where(F.col("op") == op[1]), CATALOG).select("recording_id", "seq", "hit", "subject", "detail")


for _op in (("fs_write", "fs_write"), ("fs_read", "fs_read"), ("connect", "net_connect"), ("dns", "dns_query"), ("spawn", "proc_spawn")):
    _hits_of(_op)


@query("match_rules", BASE + "SELECT recording_id, seq, rule_id, severity, subject FROM m")
def _(spark, d):
    return rules.match_rules(rules.hits(events(spark, d), CATALOG), CATALOG).select("recording_id", "seq", "rule_id", "severity", "subject")


def _evidence():
    return F.array_join(F.transform("evidence", lambda e: F.concat(e["seq"].cast("string"), F.lit("="), e["detail"])), "; ").alias("evidence")


@query("dedupe_findings", BASE + "SELECT recording_id, rule_id, subject, severity, title, occurrences, evidence FROM f")
def _(spark, d):
    return rules.findings(events(spark, d)).select("recording_id", "rule_id", "subject", "severity", "title", "occurrences", _evidence())


@query("order_findings", BASE + "SELECT recording_id, CAST(place AS INTEGER) AS place, rule_id, subject, occurrences FROM fo")
def _(spark, d):
    return rules.order_findings(rules.findings(events(spark, d))).select("recording_id", "place", "rule_id", "subject", "occurrences")


@query("bounded_evidence", BASE + "SELECT recording_id, rule_id, subject, unnest(list_slice(list(seq ORDER BY seq), 1, 5)) AS seq FROM m GROUP BY recording_id, rule_id, subject")
def _(spark, d):
    return rules.findings(events(spark, d)).select("recording_id", "rule_id", "subject", F.explode("evidence.seq").alias("seq"))


@query("severity_counts", BASE + "SELECT recording_id, critical, high, medium, low, raw, value, was_capped, raw = 0 AS is_clean FROM a")
def _(spark, d):
    e = events(spark, d)
    return rules.scores(e.select("recording_id").distinct(), rules.findings(e))


@query("recording_counts", BASE + "SELECT recording_id, observations, unresolved, n_fs_write, n_fs_read, n_net_connect, n_dns_query, n_proc_spawn FROM rc")
def _(spark, d):
    return rules.recording_counts(events(spark, d)).drop("backend", "package", "version", "complete", "has_end")


@query(
    "skipped_rules",
    BASE + "SELECT recording_id, rule_id, 'the ' || backend || ' backend does not observe ' || class AS reason FROM rc, rule WHERE backend = 'aya' AND class IN ('credential reads', 'DNS queries')",
)
def _(spark, d):
    return rules.skipped_rules(events(spark, d))


@query(
    "select_bullets",
    BASE
    + """, t AS (SELECT *, max(CASE WHEN severity <> 'low' THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id) AS scorable FROM fo
), u AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY place) AS n FROM t WHERE scorable = 0 OR severity <> 'low')
SELECT recording_id, CAST(n AS INTEGER) AS n, title || CASE WHEN severity = 'critical' THEN ' (critical)' ELSE '' END || CASE WHEN occurrences > 1 THEN ' — ' || occurrences || ' times' ELSE '' END AS bullet FROM u WHERE n <= 3""",
)
def _(spark, d):
    return rules.select_bullets(rules.findings(events(spark, d)))


@query(
    "signal_log",
    BASE
    + """, w AS (SELECT recording_id, subject, arg_min(rule_id, struct_pack(a := sev_rank, b := rule_id)) AS rule_id FROM f GROUP BY ALL
), o AS (SELECT *, coalesce(path, address, qname, prog) AS subj, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS n,
    greatest(ts_ns - coalesce(lag(ts_ns) OVER (PARTITION BY recording_id ORDER BY seq), ts_ns), 0) AS gap FROM p)
SELECT o.recording_id, n, op, subj AS subject, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'failed' ELSE 'unknown' END AS outcome, origin, CAST((gap // 1000) // 100 AS BIGINT) AS delta_tenths, rule_id
FROM o LEFT JOIN w ON w.recording_id = o.recording_id AND w.subject = o.subj""",
)
def _(spark, d):
    e = events(spark, d)
    return rules.signal_log(e, rules.findings(e))


@query(
    "signal_findings",
    BASE
    + """, w AS (SELECT recording_id, subject AS key, arg_min(rule_id, struct_pack(a := sev_rank, b := -occurrences, c := rule_id)) AS rule_id FROM f GROUP BY ALL
), o AS (SELECT *, CASE op WHEN 'proc_spawn' THEN command WHEN 'net_connect' THEN address WHEN 'dns_query' THEN qname ELSE path END AS subj, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS n,
    greatest(ts_ns - coalesce(lag(ts_ns) OVER (PARTITION BY recording_id ORDER BY seq), ts_ns), 0) AS gap FROM p
), k AS (
  SELECT o.recording_id, n, arg_min(rule_id, struct_pack(a := key <> subj, b := key)) AS rule_id
  FROM o JOIN w ON w.recording_id = o.recording_id AND (key = subj OR ends_with(key, '…') AND starts_with(subj, key[:-2]) OR key = split_part(regexp_extract(subj, '^\\s*(\\S+)', 1), '/', -1)) GROUP BY ALL
)
SELECT o.recording_id, o.n, op, subj AS subject, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'failed' ELSE 'unknown' END AS outcome, origin, CAST((gap // 1000) // 100 AS BIGINT) AS delta_tenths, k.rule_id
FROM o LEFT JOIN k ON k.recording_id = o.recording_id AND k.n = o.n""",
)
def _(spark, d):
    e = events(spark, d)
    return rules.signal_findings(e, rules.findings(e))


NOTE = lambda level, message, name: f"CASE WHEN {{}} THEN struct_pack(level := '{level}', message := {message}, id := '{name}') END"
TOLD = ", ".join(
    [
        NOTE("warning", "'The recording is incomplete, so these results are not the whole picture: ' || CASE WHEN has_end THEN 'no reason recorded' ELSE 'the recording has no session_end event; it may have been truncated' END", "partial_recording").format("is_partial"),
        NOTE("warning", "'Not checked by the aya backend: credential reads, DNS queries. Absence of these findings is not evidence they did not happen.'", "backend_coverage").format("backend = 'aya'"),
    ]
)
LEFT = NOTE("note", "unresolved || ' path(s) could not be resolved to an absolute location and were not checked against the expected directories'", "unresolved_paths").format("unresolved > 0")


@query(
    "sarif_rows",
    BASE
    + f""", res AS (
  SELECT recording_id, list(struct_pack(ruleId := rule_id, level := CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END,
    rank := CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 70 WHEN 'medium' THEN 40 ELSE 10 END, message := title, occurrences := occurrences) ORDER BY place) AS results FROM fo GROUP BY recording_id
), ru AS (
  SELECT recording_id, list(struct_pack(id := rule_id, shortDescription := title, help := 'See the rule catalog.', severity := severity) ORDER BY rule_id) AS rules
  FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, rule_id ORDER BY place) AS k FROM fo) WHERE k = 1 GROUP BY recording_id
), nr AS (
  SELECT backend AS b, list(struct_pack(level := 'note', message := 'Rule `' || rule_id || '` did not run on this backend: the ' || backend || ' backend does not observe ' || class, id := 'rule_not_run') ORDER BY rule_id) AS not_run
  FROM rule, (SELECT 'aya' AS backend) WHERE class IN ('credential reads', 'DNS queries') GROUP BY backend
)
SELECT recording_id, to_json(struct_pack(results := coalesce(results, []), rules := coalesce(rules, []), notifications := list_filter(list_concat([{TOLD}], coalesce(not_run, []), [{LEFT}]), lambda x: x IS NOT NULL))) AS sarif_json
FROM rc LEFT JOIN res USING (recording_id) LEFT JOIN ru USING (recording_id) LEFT JOIN nr ON nr.b = rc.backend""",
)
def _(spark, d):
    e = events(spark, d)
    recordings = rules.recording_counts(e).withColumn("is_partial", rules.is_partial())  # as evaluate has them, without finding everything twice
    return rules.sarif_rows(e, rules.findings(e), recordings, rules.skipped_rules(e))


@query(
    "report_markdown",
    BASE
    + """, u AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY place) AS n FROM fo WHERE severity <> 'low'
), v AS (SELECT recording_id, string_agg('- ' || title || CASE WHEN severity = 'critical' THEN ' (critical)' ELSE '' END || CASE WHEN occurrences > 1 THEN ' — ' || occurrences || ' times' ELSE '' END, chr(10) ORDER BY n) AS bullets, count(*) AS shown FROM u WHERE n <= 3 GROUP BY recording_id
), w AS (SELECT recording_id, count(*) AS total FROM f WHERE severity <> 'low' GROUP BY recording_id
), sk AS (SELECT string_agg('- `' || rule_id || '` — the aya backend does not observe ' || class, chr(10) ORDER BY rule_id) AS skipped FROM rule WHERE class IN ('credential reads', 'DNS queries'))
SELECT a.recording_id, concat_ws(chr(10), '**' || package || '@' || version || '** ' || score_text, CASE WHEN is_partial THEN 'PARTIAL: ' || CASE WHEN has_end THEN 'no reason recorded' ELSE 'the recording has no session_end event; it may have been truncated' END END,
  coalesce(bullets, CASE verdict WHEN 'clean' THEN 'Nothing outside expected behavior.' WHEN 'partial' THEN 'Recording incomplete.' WHEN 'findings' THEN 'Surprise index.' ELSE 'Nothing outside expected behavior, with gaps.' END),
  CASE WHEN total > shown THEN '- …and ' || (total - shown) || ' more finding' || CASE WHEN total - shown = 1 THEN '' ELSE 's' END || ' in the full evidence' END,
  CASE WHEN backend = 'aya' THEN 'Not checked by the aya backend: credential reads, DNS queries. Absence of these findings is not evidence they did not happen.' END,
  CASE WHEN unresolved > 0 THEN unresolved || CASE WHEN unresolved = 1 THEN ' path' ELSE ' paths' END || ' could not be resolved to an absolute location' END,
  CASE WHEN backend = 'aya' THEN 'Checks that did not run on this backend:' || chr(10) || (SELECT skipped FROM sk) END) AS markdown
FROM a LEFT JOIN v USING (recording_id) LEFT JOIN w USING (recording_id)""",
)
def _(spark, d):
    e = events(spark, d)
    found = materialize(rules.findings(e), "findings")
    return rules.report_markdown(rules.evaluate(e, found=found), found, e)


#: Behaviours, distinct per recording.
VERB = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in behavior.VERBS.items()) + " ELSE 'wrote' END"
BEHAVIOR = (
    BASE
    + f""", rel AS (
  SELECT *, CASE placement WHEN 'project' THEN zone_project WHEN 'cache' THEN zone_cache WHEN 'home' THEN zone_home WHEN 'tmp' THEN zone_tmp WHEN 'declared' THEN '' END AS prefix FROM p
), rel2 AS (SELECT *, CASE WHEN prefix IS NOT NULL THEN CASE WHEN ltrim(path[length(prefix) + 1:], '/') = '' THEN '.' ELSE ltrim(path[length(prefix) + 1:], '/') END END AS relative FROM rel
), beh AS (
  SELECT recording_id, package, version, CASE WHEN relative IS NOT NULL THEN 'wrote' WHEN placement = 'outside' THEN 'wrote_outside' WHEN placement = 'runtime' THEN 'wrote_runtime' ELSE 'wrote_unresolved' END AS variant,
    CASE WHEN relative IS NOT NULL THEN placement END AS zone, coalesce(relative, path) AS path, kind, NULL AS qname, NULL::INT AS port, NULL::BOOL AS loopback, NULL::BOOL AS private, NULL AS program, NULL AS tool
  FROM rel2 WHERE op = 'fs_write' AND NOT failed
  UNION SELECT recording_id, package, version, 'read_credential', NULL, CASE WHEN relative IS NOT NULL THEN placement || '/' || relative ELSE path END, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM rel2 WHERE op = 'fs_read'
  UNION SELECT recording_id, package, version, 'resolved', NULL, NULL, NULL, lower(qname), NULL, NULL, NULL, NULL, NULL FROM p WHERE op = 'dns_query'
  UNION SELECT recording_id, package, version, 'connected', NULL, NULL, NULL, NULL, port, loopback, private, NULL, NULL FROM p WHERE op = 'net_connect' AND unix_path IS NULL AND port <> 0
  UNION SELECT recording_id, package, version, 'connected_unix', NULL, unix_path, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE op = 'net_connect' AND unix_path IS NOT NULL
  UNION SELECT recording_id, package, version, 'spawned', NULL, NULL, NULL, NULL, NULL, NULL, NULL, prog, NULL FROM p WHERE op = 'proc_spawn'
  UNION SELECT recording_id, package, version, 'spawned_shell_pipeline', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'curl' FROM p WHERE script IS NOT NULL
), bs AS (
  SELECT *, CASE WHEN variant = 'wrote_outside' THEN 'writes outside expected directories' WHEN variant = 'read_credential' THEN 'credential reads' WHEN variant IN ('resolved', 'connected', 'connected_unix') THEN 'network' WHEN starts_with(variant, 'spawned') THEN 'processes' ELSE 'filesystem' END AS class,
    CASE variant WHEN 'wrote' THEN {VERB} || ' ' || zone || '/' || path WHEN 'wrote_outside' THEN {VERB} || ' ' || path || ' (outside expected directories)' WHEN 'wrote_runtime' THEN {VERB} || ' ' || path
      WHEN 'wrote_unresolved' THEN {VERB} || ' ' || path || ' (path unresolved by the recorder)' WHEN 'read_credential' THEN 'read ' || path WHEN 'resolved' THEN 'resolved ' || qname
      WHEN 'connected' THEN 'connected to port ' || port || CASE WHEN loopback THEN ' (loopback)' WHEN private THEN ' (private network)' ELSE '' END
      WHEN 'connected_unix' THEN 'connected to unix socket ' || path WHEN 'spawned' THEN 'ran ' || program ELSE 'piped ' || tool || ' output into a shell' END AS summary
  FROM beh
), pr AS (
  SELECT package, version AS before_version, lead(version) OVER (PARTITION BY package ORDER BY first_seen) AS after_version FROM (SELECT package, version, min(append_pos) AS first_seen FROM b GROUP BY ALL)
), tagged AS (
  SELECT pr.package, before_version, after_version, true AS old, bs.* EXCLUDE (package, version, recording_id) FROM pr JOIN bs ON bs.package = pr.package AND bs.version = before_version WHERE after_version IS NOT NULL
  UNION ALL SELECT pr.package, before_version, after_version, false, bs.* EXCLUDE (package, version, recording_id) FROM pr JOIN bs ON bs.package = pr.package AND bs.version = after_version
), vd AS (
  SELECT package, before_version, after_version, variant, zone, path, kind, qname, port, loopback, private, program, tool, class, summary,
    CASE WHEN bool_or(old) AND bool_or(NOT old) THEN 'unchanged' WHEN bool_or(old) THEN 'removed' ELSE 'added' END AS change
  FROM tagged GROUP BY ALL
), un AS (SELECT package, version, count(*) FILTER (placement = 'unresolvable' AND (op = 'fs_read' OR op = 'fs_write' AND NOT failed)) AS unresolved_paths, arg_min(backend, seq) AS backend, bool_or(complete AND has_end) AS whole, any_value(agent_version) AS agent_version FROM p GROUP BY ALL
), cs0 AS (
  SELECT package, before_version, after_version, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged,
    coalesce(string_agg(DISTINCT class, ', ' ORDER BY class) FILTER (change <> 'unchanged'), '') AS changed_classes
  FROM pr LEFT JOIN vd USING (package, before_version, after_version) WHERE after_version IS NOT NULL GROUP BY ALL
), cs AS (
  SELECT cs0.*, concat_ws(',', CASE WHEN x.backend <> y.backend THEN 'backend_mismatch' END, CASE WHEN NOT x.whole THEN 'partial_before' END, CASE WHEN NOT y.whole THEN 'partial_after' END) AS blockers,
    concat_ws(';', CASE WHEN x.agent_version <> y.agent_version THEN 'agent_version:' || x.agent_version || '>' || y.agent_version END, CASE WHEN x.unresolved_paths > 0 THEN 'unresolved_before:' || x.unresolved_paths END, CASE WHEN y.unresolved_paths > 0 THEN 'unresolved_after:' || y.unresolved_paths END,
      CASE WHEN x.backend = 'aya' AND y.backend = 'aya' THEN 'blind_spots:credential reads, DNS queries' END) AS caveats,
    CASE WHEN blockers <> '' THEN 'cannot be compared' WHEN added = 0 AND removed = 0 THEN 'behaved identically' ELSE 'behavior changed' END AS headline
  FROM cs0 JOIN un x ON x.package = cs0.package AND x.version = before_version JOIN un y ON y.package = cs0.package AND y.version = after_version
), sw AS (
  SELECT package, before_version, after_version, CAST(100 + sum(CASE class WHEN 'writes outside expected directories' THEN 500 WHEN 'credential reads' THEN 400 WHEN 'network' THEN 300 WHEN 'processes' THEN 200 ELSE 1 END + round(log2(n + 1))) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS additions
  FROM (SELECT package, before_version, after_version, class, count(*) AS n FROM vd WHERE change = 'added' GROUP BY ALL) GROUP BY ALL
)
"""
)


@query("profile", BEHAVIOR + "SELECT recording_id, variant, zone, path, kind, qname, port, loopback, private, program, tool FROM beh")
def _(spark, d):
    return behavior.profile(events(spark, d)).drop("package", "version")


@query("behavior_summary", BEHAVIOR + "SELECT recording_id, class, summary, class <> 'filesystem' AS notable FROM bs")
def _(spark, d):
    rows = behavior.profile(events(spark, d)).select("recording_id", behavior.behavior_class().alias("class"), behavior.behavior_summary().alias("summary"))
    return rows.withColumn("notable", F.col("class") != "filesystem")


@query("observations_by_class", BEHAVIOR + "SELECT class, count(*) AS observations FROM bs GROUP BY class")
def _(spark, d):
    return behavior.profile(events(spark, d)).groupBy(behavior.behavior_class().alias("class")).agg(F.count(F.lit(1)).alias("observations"))


@query(
    "corpus_summary",
    BEHAVIOR
    + """, v AS (SELECT package, version, bool_or(complete) AS complete FROM b GROUP BY ALL), k AS (SELECT package, count(*) AS n, count(*) FILTER (NOT complete) AS incomplete FROM v GROUP BY ALL)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM k) AS snapshots, (SELECT count(*) FROM k) AS packages, (SELECT count(*) FROM k WHERE n > 1) AS packages_with_history, (SELECT CAST(sum(n - 1) AS BIGINT) FROM k) AS diffable_pairs, (SELECT CAST(sum(incomplete) AS BIGINT) FROM k) AS incomplete,
  count(*) AS observations, count(DISTINCT summary) AS distinct_behaviors, count(*) FILTER (class = 'writes outside expected directories') AS outside, count(*) FILTER (class = 'credential reads') AS credential_reads,
  count(*) FILTER (class = 'network') AS network, count(*) FILTER (class = 'processes') AS processes, count(*) FILTER (class = 'filesystem') AS filesystem FROM bs""",
)
def _(spark, d):
    return behavior.corpus_summary(events(spark, d))


@query("consecutive_versions", BEHAVIOR + "SELECT package, before_version, after_version FROM pr WHERE after_version IS NOT NULL")
def _(spark, d):
    return behavior.version_pairs(behavior.recordings_of(events(spark, d))).drop("before_id", "after_id")


@query("version_diff", BEHAVIOR + "SELECT package, before_version, after_version, class, summary, kind, change FROM vd")
def _(spark, d):
    return behavior.version_diff(events(spark, d)).select("package", "before_version", "after_version", "class", "summary", "kind", "change")


@query(
    "comparison_classes",
    BEHAVIOR
    + """SELECT package, before_version, after_version, class, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'unchanged') AS unchanged FROM vd GROUP BY ALL""",
)
def _(spark, d):
    return behavior.class_counts(behavior.version_diff(events(spark, d)))


@query("comparison_summary", BEHAVIOR + "SELECT *, blockers = '' AS comparable, added = 0 AND removed = 0 AS identical FROM cs")
def _(spark, d):
    return behavior.comparison_summary(events(spark, d))


RANK = "CASE class WHEN 'writes outside expected directories' THEN 1 WHEN 'credential reads' THEN 2 WHEN 'network' THEN 3 WHEN 'processes' THEN 4 ELSE 5 END"


@query(
    "diff_highlights",
    BEHAVIOR
    + f"""SELECT package, before_version, after_version, CAST(n AS INTEGER) AS n, class, summary FROM (
  SELECT *, row_number() OVER (PARTITION BY package, before_version, after_version ORDER BY {RANK}, summary) AS n FROM (SELECT DISTINCT package, before_version, after_version, class, summary FROM vd WHERE change = 'added')) WHERE n <= 5""",
)
def _(spark, d):
    return behavior.diff_highlights(behavior.version_diff(events(spark, d)))


@query(
    "capped_by_class",
    BEHAVIOR
    + """SELECT package, before_version, after_version, change, class, CAST(n AS INTEGER) AS n, summary, greatest(total - 8, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY package, before_version, after_version, change, class ORDER BY summary) AS n, count(*) OVER (PARTITION BY package, before_version, after_version, change, class) AS total
  FROM (SELECT DISTINCT package, before_version, after_version, change, class, summary FROM vd WHERE change <> 'unchanged')) WHERE n <= 8""",
)
def _(spark, d):
    return behavior.capped_by_class(behavior.version_diff(events(spark, d)))


@query("surprise_weight", BEHAVIOR + "SELECT * FROM sw")
def _(spark, d):
    return behavior.surprise_weight(behavior.version_diff(events(spark, d)))


@query("review_queue", BEHAVIOR + "SELECT sw.* FROM sw JOIN cs USING (package, before_version, after_version) WHERE blockers = '' ORDER BY weight DESC, package, after_version LIMIT 20")
def _(spark, d):
    e = events(spark, d)
    diff = materialize(behavior.version_diff(e), "diff")
    return behavior.review_queue(behavior.comparison_summary(e, diff), behavior.surprise_weight(diff))
