"""From events to findings, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoor.catalog import SEVERITIES, UNOBSERVED, WEIGHTS, Catalog, caveats, coverage
from spoor.functions import network as net, paths, process as proc
from spoor.scratch import materialize

FRAMING = ("session_start", "session_end", "heartbeat")
#: What not every source of events has.
OPTIONAL = {"error": "string", "unix_path": "string", "loopback": "boolean", "private": "boolean"}
EVIDENCE = 5
BULLETS = 3


def placed(events: DataFrame) -> DataFrame:
    """Events with ``placement``, the zone of their path. Columns of OPTIONAL that they lack are null."""
    c = F.col
    if getattr(events, "is_placed", False):
        return events
    events = events.withColumns({k: F.lit(None).cast(t) for k, t in OPTIONAL.items() if k not in events.columns})
    return once(events, "placement", F.when(c("path").isNotNull(), paths.placement(c("path"), c("origin"), c("zone_project"), c("zone_cache"), c("zone_home"), c("zone_tmp"), c("extra"))))


def placed_once(events: DataFrame) -> DataFrame:
    """``placed`` events, written, for what reads them several times. Only the very table is known to be placed; what is derived from
    it is placed anew."""
    if getattr(events, "is_placed", False):
        return events
    out = materialize(placed(events), "placed")
    out.is_placed = True
    return out


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is worked out once a row: an array of one is opened, which the optimizer does not copy
    into everything that uses the column."""
    return rows.select(*[c for c in rows.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def write_kind(failed: Column) -> Column:
    outside = (F.col("placement") == "outside") & ~failed
    executable = (F.col("kind") == "chmod") & paths.is_executable_mode(F.col("mode"))
    return F.when(outside & executable, "chmod_executable_outside_zones").when(outside, "write_outside_zones")


def read_kind(failed: Column, catalog: Catalog) -> Column:
    path = F.col("path")
    credential = paths.is_credential_path(path, catalog.credential_paths, catalog.credential_filenames)
    return F.when(path.endswith("/.npmrc") | path.endswith("/.yarnrc"), "npmrc_read").when(credential & failed, "credential_read_failed").when(credential, "credential_read")


def connect_kind(failed: Column) -> Column:
    # The recorder says what is near; a recording that does not say so is judged by its address.
    near = F.coalesce("loopback", net.is_loopback(F.col("ip"))) | F.coalesce("private", net.is_private(F.col("ip")))
    counts = F.col("ip").isNotNull() & ~near & ~failed
    return F.when(counts & net.is_unusual_port(F.col("port")), "connect_unusual_port").when(counts, "connect_external")


def dns_kind(catalog: Catalog) -> Column:
    host = F.col("qname")
    ordinary = net.host_matches(host, catalog.registry_hosts, catalog.registry_suffixes) | ~host.contains(".")
    return F.when(ordinary, None).when(net.host_matches(host, [], catalog.binary_distribution_suffixes), "dns_binary_distribution").otherwise("dns_outside_registry")


def spawn_kind(catalog: Catalog) -> Column:
    name = paths.basename(F.col("bin"))
    return (
        F.when(proc.pipes_download_to_shell(F.col("argv"), F.col("argv_truncated")), "download_piped_to_shell")
        .when(name.isin(catalog.network_tools), "spawn_network_tool")
        .when(name.isNotNull() & ~name.isin(catalog.expected_spawns), "spawn_unexpected")
    )


def hits(events: DataFrame, catalog: Catalog) -> DataFrame:
    """``recording_id, seq, ts_ns, pid, op, backend, hit, subject, detail``: the events that some kind of rule asks
    about. One projection and a filter, before anything is shuffled."""
    failed = F.coalesce(~F.col("ok"), F.lit(False))  # an unknown outcome is not a failure
    op = F.col("op")
    hit = (
        F.when(op == "fs_write", write_kind(failed))
        .when(op == "fs_read", read_kind(failed, catalog))
        .when(op == "net_connect", connect_kind(failed))
        .when(op == "dns_query", dns_kind(catalog))
        .when(op == "proc_spawn", spawn_kind(catalog))
    )
    command = proc.command_line(F.col("argv"), F.col("bin"))
    address = F.concat("ip", F.coalesce(F.concat(F.lit(":"), F.col("port").cast("string")), F.lit("")))
    subject = (
        F.when(op.isin("fs_write", "fs_read"), F.col("path"))
        .when(op == "net_connect", address)
        .when(op == "dns_query", F.col("qname"))
        .when(F.col("hit") == "download_piped_to_shell", proc.truncate_subject(command))
        .otherwise(paths.basename(F.col("bin")))
    )
    volume = F.concat(F.initcap("kind"), F.coalesce(F.concat(F.lit(" "), F.col("bytes").cast("string"), F.lit(" bytes")), F.lit("")))
    detail = (
        F.when(F.col("hit") == "chmod_executable_outside_zones", F.concat(F.lit("chmod "), F.coalesce("mode", F.lit("?")), F.lit(" "), "path"))
        .when(op == "fs_write", volume)
        .when(F.col("hit") == "npmrc_read", "read package manager config")
        .when(F.col("hit") == "credential_read_failed", F.concat(F.lit("failed: "), F.coalesce("error", F.lit("unknown error"))))
        .when(op == "fs_read", "read succeeded")
        .when(op == "net_connect", F.concat(F.lit("connected to "), address))
        .when(op == "dns_query", F.concat(F.lit("resolved "), "qname"))
        .when(F.col("hit") == "download_piped_to_shell", command)
        .otherwise(proc.truncate_subject(command))
    )
    rows = once(placed(events), "hit", hit).where(F.col("hit").isNotNull())
    return rows.select("recording_id", "seq", "ts_ns", "pid", "op", "backend", "hit", subject.alias("subject"), detail.alias("detail"))


def match_rules(found: DataFrame, catalog: Catalog) -> DataFrame:
    """Hits with the rule of their kind; kinds without an enabled rule and classes that the
    recording's own recorder cannot see drop out. The rules are a dozen rows."""
    spark = found.sparkSession
    seen = coverage(spark).where("observability <> 'unobserved'").select("backend", "class")
    first = found.join(F.broadcast(catalog.rows(spark)), found["hit"] == F.col("kind")).drop("kind")
    return first.join(F.broadcast(seen), ["backend", "class"])


def dedupe_findings(found: DataFrame) -> DataFrame:
    """``recording_id, rule_id, subject, severity, sev_rank, title, occurrences, evidence``: the worst
    severity, and the first five pieces of evidence in stream order.

    Evidence is cut to five per task before it is shuffled (the rank limit is pushed below the exchange),
    so a busy loop on one subject costs no more than any other.
    """
    key = ["recording_id", "rule_id", "subject"]
    totals = found.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("sev_rank", "severity", "title")).alias("worst"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where(F.col("n") <= EVIDENCE)
    evidence = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "ts_ns", "pid", "op", "detail"))).alias("evidence"))
    return totals.join(evidence, key).select(*key, "worst.severity", "worst.sev_rank", F.concat("worst.title", F.lit(": "), "subject").alias("title"), "occurrences", "evidence")


def order_findings(findings: DataFrame) -> DataFrame:
    """Findings with ``place`` in the report of their recording."""
    order = Window.partitionBy("recording_id").orderBy("sev_rank", F.desc("occurrences"), "rule_id", "subject")
    return findings.withColumn("place", F.row_number().over(order))


def recording_counts(events: DataFrame) -> DataFrame:
    """Per recording what was observed: observations, unresolved writes (failed ones too), each op."""
    count = lambda cond: F.count(F.when(cond, 1))
    op = F.col("op")
    ops = ["fs_write", "fs_read", "net_connect", "dns_query", "proc_spawn"]
    return placed(events).groupBy("recording_id").agg(
        count(~op.isin(*FRAMING)).alias("observations"),
        count((op == "fs_write") & (F.col("placement") == "unresolvable")).alias("unresolved"),
        *[count(op == o).alias(f"n_{o}") for o in ops],
        F.min_by("backend", "seq").alias("backend"),
        F.max("package").alias("package"),
        F.max("version").alias("version"),
        F.max("complete").alias("complete"),
        F.max("has_end").alias("has_end"),
    )


def scores(recordings: DataFrame, findings: DataFrame) -> DataFrame:
    """Per recording the counts by severity and the score: weights of all findings but low ones, at most 100."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    raw = F.coalesce(F.sum(F.when(F.col("severity") != "low", F.element_at(F.create_map(*[F.lit(x) for s in SEVERITIES for x in (s, WEIGHTS[s])]), F.col("severity")))), F.lit(0))
    totals = findings.groupBy("recording_id").agg(*map(count, SEVERITIES), raw.alias("raw"))
    rows = recordings.join(totals, "recording_id", "left")
    raw = F.coalesce("raw", F.lit(0)).cast("long")
    return rows.select(
        "recording_id",
        *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in SEVERITIES],
        raw.alias("raw"),
        F.least(raw, F.lit(100)).cast("long").alias("value"),
        (raw > 100).alias("was_capped"),
        (raw == 0).alias("is_clean"),
    )


def is_partial() -> Column:
    return ~(F.col("complete") & F.col("has_end"))


def verdict() -> Column:
    """partial before findings before clean; clean with a caveat where the recorder has blind spots, paths stayed
    unresolved or nothing was observed at all."""
    blind = F.col("backend").isin(sorted({b for b, _ in UNOBSERVED}))
    caveat = blind | (F.col("unresolved") > 0) | (F.col("observations") == 0)
    return F.when(is_partial(), "partial").when(~F.col("is_clean"), "findings").when(caveat, "clean_with_caveat").otherwise("clean")


def format_score() -> Column:
    return F.concat(F.col("value").cast("string"), F.lit(" / 100"), F.when(F.col("was_capped"), F.concat(F.lit(" (raw "), F.col("raw").cast("string"), F.lit(")"))).otherwise(""))


def format_bullet() -> Column:
    mark = F.when(F.col("severity") == "critical", " (critical)").otherwise("")
    times = F.when(F.col("occurrences") > 1, F.concat(F.lit(" — "), F.col("occurrences").cast("string"), F.lit(" times"))).otherwise("")
    return F.concat("title", mark, times)


def findings(events: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """All findings. The hits, a small part of the events, are written once: totals and evidence both read them."""
    catalog = catalog or Catalog()
    return dedupe_findings(match_rules(materialize(hits(events, catalog), "hits"), catalog))


def evaluate(events: DataFrame, catalog: Catalog | None = None, found: DataFrame | None = None) -> DataFrame:
    """The whole analysis, a row per recording: score, verdict, counts. ``found``: the findings, where they are there already."""
    events = placed_once(events) if found is None else events
    recordings = recording_counts(events)
    scored = scores(recordings.select("recording_id"), findings(events, catalog) if found is None else found)
    rows = recordings.join(scored, "recording_id")
    return rows.select(
        "recording_id", "package", "version", "backend", "observations", "unresolved", *SEVERITIES, "raw", "value", "was_capped", is_partial().alias("is_partial"), verdict().alias("verdict"), format_score().alias("score_text")
    )


def skipped_rules(events: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Per recording the enabled rules that its recorder cannot see. Only the recordings' backends are
    joined, with two dozen rows."""
    spark = events.sparkSession
    rules = (catalog or Catalog()).rows(spark)
    blind = rules.join(coverage(spark).where("observability = 'unobserved'"), "class").select("backend", "rule_id", "class")
    recordings = events.groupBy("recording_id").agg(F.min_by("backend", "seq").alias("backend"))
    return recordings.join(F.broadcast(blind), "backend").select("recording_id", "rule_id", F.concat(F.lit("the "), "backend", F.lit(" backend does not observe "), "class").alias("reason"))


def select_bullets(found: DataFrame) -> DataFrame:
    """The first three findings that count; only if there are none, the first three low ones."""
    ordered = order_findings(found)
    scorable = F.max((F.col("severity") != "low").cast("int")).over(Window.partitionBy("recording_id"))
    kept = ordered.withColumn("scorable", scorable).where((F.col("scorable") == 0) | (F.col("severity") != "low"))
    order = Window.partitionBy("recording_id").orderBy("place")
    return kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= BULLETS).select("recording_id", "n", format_bullet().alias("bullet"))


def signal_log(events: DataFrame, found: DataFrame) -> DataFrame:
    """Observations in stream order with the time since the one before, in tenths of a millisecond,
    and the worst finding about their subject."""
    order = Window.partitionBy("recording_id").orderBy("seq")
    address = F.concat("ip", F.coalesce(F.concat(F.lit(":"), F.col("port").cast("string")), F.lit("")))
    subject = F.coalesce("path", F.when(F.col("op") == "net_connect", address), "qname", paths.basename(F.col("bin")))
    gap = F.greatest(F.col("ts_ns") - F.coalesce(F.lag("ts_ns").over(order), F.col("ts_ns")), F.lit(0))
    tenths = F.floor(F.floor(gap / 1000) / 100).cast("long")
    rows = events.where(~F.col("op").isin(*FRAMING)).select("recording_id", "seq", "op", subject.alias("subject"), "ok", "origin", F.row_number().over(order).cast("long").alias("n"), tenths.alias("delta_tenths"))
    worst = found.groupBy("recording_id", "subject").agg(F.min(F.struct("sev_rank", "rule_id")).alias("w")).select("recording_id", "subject", "w.rule_id")
    return rows.join(worst, ["recording_id", "subject"], "left").select("recording_id", "n", "op", "subject", F.when(F.col("ok"), "ok").when(~F.col("ok"), "failed").otherwise("unknown").alias("outcome"), "origin", "delta_tenths", "rule_id")


def signal_findings(events: DataFrame, found: DataFrame) -> DataFrame:
    """``signal_log`` with the whole command line as a spawn's subject and the address alone where a connection has
    no port. A subject without a finding of its own takes the first, in order of the text, of those that end in an
    ellipsis and that it begins with, or that are the basename of its first word."""
    c = F.col
    order = Window.partitionBy("recording_id").orderBy("seq")
    address = F.concat("ip", F.coalesce(F.concat(F.lit(":"), c("port").cast("string")), F.lit("")))
    subject = F.when(c("op") == "proc_spawn", proc.command_line(c("argv"), c("bin"))).when(c("op") == "net_connect", address).when(c("op") == "dns_query", c("qname")).otherwise(c("path"))
    rows = signal_log(events, found).drop("rule_id", "subject")
    subjects = events.where(~c("op").isin(*FRAMING)).select("recording_id", F.row_number().over(order).cast("long").alias("n"), subject.alias("subject"))
    rows = rows.join(subjects, ["recording_id", "n"])

    worst = found.groupBy("recording_id", c("subject").alias("key")).agg(F.min(F.struct("sev_rank", (-c("occurrences")).alias("o"), "rule_id")).alias("w")).select("recording_id", "key", "w.rule_id")
    # The lengths of a recording's cut subjects, as a rule one: every start of these lengths is looked up by an equi-join.
    cut = worst.where(c("key").endswith("…")).groupBy("recording_id").agg(F.collect_set(F.char_length("key") - 1).alias("lengths"))
    told = subjects.select("recording_id", "subject").where("subject is not null").distinct().join(cut, "recording_id", "left")
    none = F.array().cast("array<string>")
    starts = F.transform(F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.char_length("subject")), lambda n: F.concat(F.substring(c("subject"), F.lit(1), n), F.lit("…")))
    word = F.regexp_extract("subject", r"(?U)^\s*(\S+)", 1)
    keys = F.array_distinct(F.concat(F.array("subject"), starts, F.when(word != "", F.array(paths.basename(word))).otherwise(none)))
    met = told.select("recording_id", "subject", F.explode(keys).alias("key")).join(worst, ["recording_id", "key"])
    best = met.groupBy("recording_id", "subject").agg(F.min(F.struct((c("key") != c("subject")).alias("other"), "key", "rule_id")).alias("b")).select("recording_id", "subject", "b.rule_id")
    return rows.join(best, ["recording_id", "subject"], "left").select("recording_id", "n", "op", "subject", "outcome", "origin", "delta_tenths", "rule_id")


def partial_reasons(events: DataFrame) -> DataFrame:
    """``recording_id, reasons``: why a recording is incomplete, as far as its end says so."""
    said = F.array_join(F.max("incomplete_reasons"), "; ") if "incomplete_reasons" in events.columns else F.lit("")
    rows = events.groupBy("recording_id").agg(F.max("has_end").alias("has_end"), said.alias("said"))
    none = F.lit("the recording has no session_end event; it may have been truncated")
    return rows.select("recording_id", F.when(~F.col("has_end"), none).when(F.col("said") != "", F.col("said")).otherwise("no reason recorded").alias("reasons"))


def sarif_rows(events: DataFrame, found: DataFrame, analysis: DataFrame, skipped: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Per recording, with findings or not, one SARIF-shaped JSON text of results, of the rules that fired in the words
    of their first finding, and of notifications: partial, blind spots, rules that did not run, unresolved paths."""
    spark, c, text = found.sparkSession, F.col, F.lit
    level = F.when(c("severity").isin("critical", "high"), "error").when(c("severity") == "medium", "warning").otherwise("note")
    rank = F.when(c("severity") == "critical", 100).when(c("severity") == "high", 70).when(c("severity") == "medium", 40).otherwise(10)
    ordered = order_findings(found)
    row = F.struct("place", c("rule_id").alias("ruleId"), level.alias("level"), rank.alias("rank"), c("title").alias("message"), "occurrences")
    results = ordered.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("place")).alias("results"))

    notes = spark.createDataFrame([(r.id, r.note or "See the rule catalog.") for r in (catalog or Catalog()).rules], "rule_id string, help string")
    first = ordered.groupBy("recording_id", "rule_id").agg(F.min_by(F.struct("title", "severity"), "place").alias("f")).join(F.broadcast(notes), "rule_id")
    rule = F.struct(c("rule_id").alias("id"), c("f.title").alias("shortDescription"), "help", "f.severity")
    rules = first.groupBy("recording_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))

    def note(level: str, message: Column, name: str) -> Column:
        return F.struct(text(level).alias("level"), message.alias("message"), text(name).alias("id"))

    ran = F.concat(text("Rule `"), "rule_id", text("` did not run on this backend: "), "reason")
    not_run = skipped.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", ran.alias("m")))), lambda s: note("note", s["m"], "rule_not_run")).alias("not_run"))
    blind = coverage(spark).where("observability = 'unobserved'").groupBy("backend").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "class"))), lambda x: x["class"]), ", ").alias("blind"))
    rows = analysis.select("recording_id", "backend", "is_partial", "unresolved").join(F.broadcast(blind), "backend", "left")
    for part in (partial_reasons(events), results, rules, not_run):
        rows = rows.join(part, "recording_id", "left")
    partial = F.when(c("is_partial"), note("warning", F.concat(text("The recording is incomplete, so these results are not the whole picture: "), "reasons"), "partial_recording"))
    caveat = F.when(c("blind").isNotNull(), note("warning", F.concat(text("Not checked by the "), "backend", text(" backend: "), "blind", text(". Absence of these findings is not evidence they did not happen.")), "backend_coverage"))
    paths_left = F.concat(c("unresolved").cast("string"), text(" path(s) could not be resolved to an absolute location and were not checked against the expected directories"))
    unresolved = F.when(c("unresolved") > 0, note("note", paths_left, "unresolved_paths"))
    told = F.array_compact(F.concat(F.array(partial, caveat), F.coalesce("not_run", F.array().cast(not_run.schema["not_run"].dataType)), F.array(unresolved)))
    empty = lambda name, df: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    return rows.select("recording_id", F.to_json(F.struct(empty("results", results), empty("rules", rules), told.alias("notifications"))).alias("sarif_json"))


#: What a report says where it has no finding to show.
HEADLINES = {"clean": "Nothing outside expected behavior", "findings": "Surprise index", "partial": "Recording incomplete", "clean_with_caveat": "Nothing outside expected behavior, with gaps"}


def report_markdown(analysis: DataFrame, found: DataFrame, events: DataFrame) -> DataFrame:
    """A short text per recording: score, PARTIAL mark with its reasons, at most three bullets of findings that count and how many more of
    these, or a sentence where there are none, what its recorder cannot see, unresolved paths, and the checks that did not run."""
    found = found.where("severity <> 'low'")
    bullets = select_bullets(found).groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "bullet"))), lambda b: F.concat(F.lit("- "), b["bullet"])), "\n").alias("bullets"), F.count(F.lit(1)).alias("shown"))
    totals = found.groupBy("recording_id").agg(F.count(F.lit(1)).alias("total"))
    rows = analysis.join(totals, "recording_id", "left").join(bullets, "recording_id", "left").join(partial_reasons(events), "recording_id", "left")
    rows = rows.join(F.broadcast(caveats(analysis.sparkSession).select("backend", "caveat")), "backend", "left")
    skipped = skipped_rules(events).groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "reason"))), lambda s: F.concat(F.lit("- `"), s["rule_id"], F.lit("` — "), s["reason"])), "\n").alias("skipped"))
    rows = rows.join(skipped, "recording_id", "left")
    more = F.col("total") - F.col("shown")
    headline = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in HEADLINES.items() for x in kv]), F.col("verdict")), F.lit("."))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("**"), "package", F.lit("@"), "version", F.lit("** "), "score_text"),
        F.when(F.col("is_partial"), F.concat(F.lit("PARTIAL: "), "reasons")),
        F.coalesce("bullets", headline),
        F.when(more > 0, F.concat(F.lit("- …and "), more.cast("string"), F.lit(" more finding"), F.when(more == 1, "").otherwise("s"), F.lit(" in the full evidence"))),
        F.col("caveat"),
        F.when(F.col("unresolved") > 0, F.concat(F.col("unresolved").cast("string"), F.when(F.col("unresolved") == 1, " path").otherwise(" paths"), F.lit(" could not be resolved to an absolute location"))),
        F.when(F.col("skipped").isNotNull(), F.concat(F.lit("Checks that did not run on this backend:\n"), "skipped")),
    )
    return rows.select("recording_id", text.alias("markdown"))


def host_classes(hosts: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """``host`` to ``host, host_class``: registry, binary_distribution or other. Each different host is taken apart into its
    label suffixes once and joined with the catalog's few dozen entries; a registry's entry counts before the other kind."""
    catalog, spark = catalog or Catalog(), hosts.sparkSession
    bare = lambda s: s.lstrip(".").lower()
    entries = [(bare(s), True, 0, "registry") for s in catalog.registry_suffixes] + [(h.lower(), False, 0, "registry") for h in catalog.registry_hosts] + [(bare(s), True, 1, "binary_distribution") for s in catalog.binary_distribution_suffixes]
    table = spark.createDataFrame(entries, "suffix string, below boolean, rank int, host_class string")
    rows = hosts.select("host").distinct().select("host", F.posexplode(net.label_suffixes(F.col("host"))).alias("pos", "suffix"))
    met = rows.join(F.broadcast(table), "suffix").where("below or pos = 0").groupBy("host").agg(F.min(F.struct("rank", "host_class")).alias("best"))
    return hosts.join(met, "host", "left").select(*hosts.columns, F.coalesce("best.host_class", F.lit("other")).alias("host_class"))
