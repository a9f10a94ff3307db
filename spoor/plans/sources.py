"""Queries that write recordings from the tables and read them back, in batches and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spoor.operators import corpus, rules
from spoor.plans import bridge
from spoor.plans.security import BASE
from spoor.scratch import materialize, shared_dir
from spoor.sources import lockfiles, recordings
from spoor.sources.store import SnapshotStore
from spoor.streaming import live, sessions

Q, SQL = {}, {}


def _dropped(spark, d, packed: bool = False) -> str:
    path = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    recordings.write_recordings(recordings.lines_of(bridge.events(spark, d)), path, packed)
    return path


def read_recordings(spark, d):
    return _observed(recordings.read_recordings(spark, _dropped(spark, d, packed=True), packed=True)[0])  # numbers as written


def read_recording_folders(spark, d):
    events = recordings.read_recordings(spark, _dropped(spark, d))[0]
    return _observed(events.withColumn("seq", F.col("seq") - 1))  # numbers of lines, from 1


def _observed(events):
    return events.where(~F.col("op").isin(*rules.FRAMING)).select(F.col("recording_id").cast("long").alias("recording_id"), "seq", "ts_ns", "op", "ok", F.col("target.path").alias("path"), "bytes", "port", "qname", "bin")


def stream_summary(spark, d):
    events, _ = recordings.read_recordings(spark, _dropped(spark, d, packed=True), "quarantine", packed=True)
    rows = recordings.stream_summary(events)
    return rows.withColumn("recording_id", F.col("recording_id").cast("long"))


def attach_session(spark, d):
    events, _ = recordings.read_recordings(spark, _dropped(spark, d, packed=True), "quarantine", packed=True)
    rows = recordings.attach_session(events).where(~F.col("op").isin(*rules.FRAMING))
    return rows.groupBy(F.col("recording_id").cast("long").alias("recording_id")).agg(F.max("zone_project").alias("zone_project"), F.max("backend").alias("backend"), F.max("complete").alias("complete"), F.max("has_end").alias("has_end"), F.count(F.lit(1)).alias("events"))


def stream_ingest(spark, d):
    rows = live.stream_ingest(spark, _dropped(spark, d)).where(~F.col("op").isin(*rules.FRAMING))
    counted = rows.groupBy(F.col("recording_id").cast("long").alias("recording_id"), "op").agg(F.count(F.lit(1)).alias("n"))
    return live.run_once(counted, "complete", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


def live_score(spark, d):
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = bridge.events(spark, d)
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return live.run_once(live.live_findings(stream), "complete", folder)


def live_scores(spark, d):
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = bridge.events(spark, d)
    last = events.where("has_end").groupBy("recording_id").agg(F.max("seq").alias("last"), F.max("complete").alias("complete"))
    ends = last.select("recording_id", (F.col("last") + 1).alias("seq"), F.lit("session_end").alias("op"), "complete")
    events.drop("complete", "has_end").unionByName(ends, allowMissingColumns=True).write.parquet(f"{folder}/in")
    written = spark.read.parquet(f"{folder}/in").schema
    stream = spark.readStream.schema(written).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return live.live_scores(live.run_once(live.live_state(stream), "complete", folder))


def snapshot_push_recordings(spark, d):
    """The written recordings pushed to a store that has those of the versions 1.2.0."""
    about = bridge.events(spark, d).groupBy("recording_id").agg(F.max("package").alias("package"), F.max("version").alias("version"))
    files = recordings.read_files(spark, _dropped(spark, d)).withColumn("recording_id", F.col("recording_id").cast("long"))
    contents = materialize(files.join(about, "recording_id").select("recording_id", "package", "version", "content"), "contents")
    nothing = spark.createDataFrame([], "digest string")
    known = corpus.snapshot_push(contents.where("version = '1.2.0'"), nothing).where("stored").select("digest")
    return corpus.snapshot_push(contents, known)


Q["read_recordings"] = read_recordings
SQL["read_recordings"] = BASE + "SELECT recording_id, seq, ts_ns, op, ok, path, bytes, port, qname, bin FROM p"
Q["read_recording_folders"] = read_recording_folders
SQL["read_recording_folders"] = SQL["read_recordings"]
Q["stream_summary"] = stream_summary
SQL["stream_summary"] = BASE + "SELECT recording_id, count(*) AS events, 0::BIGINT AS heartbeats, bool_or(complete AND has_end) AS complete, true AS has_session_start, CASE WHEN NOT bool_or(has_end) THEN 'no session_end' END AS error, CASE WHEN bool_or(has_end) THEN CAST(max(seq) % 3 AS INTEGER) END AS exit_code, CASE WHEN bool_or(has_end) AND NOT bool_or(complete) THEN 'recording interrupted' END AS reasons FROM p GROUP BY recording_id"
Q["attach_session"] = attach_session
SQL["attach_session"] = BASE + "SELECT recording_id, any_value(zone_project) AS zone_project, arg_min(backend, seq) AS backend, bool_or(complete AND has_end) AS complete, bool_or(has_end) AS has_end, count(*) AS events FROM p GROUP BY recording_id"
Q["stream_ingest"] = stream_ingest
SQL["stream_ingest"] = BASE + "SELECT recording_id, op, count(*) AS n FROM p GROUP BY ALL"
Q["live_score"] = live_score
SQL["live_score"] = BASE + "SELECT recording_id, rule_id, subject, occurrences, severity FROM f"
Q["live_scores"] = live_scores
SQL["live_scores"] = BASE + "SELECT recording_id, critical, high, medium, low, raw, value, was_capped, raw = 0 AS is_clean, is_partial FROM a"
Q["snapshot_push_recordings"] = snapshot_push_recordings


def read_lockfiles(spark, d):
    """The lock packages of each repository and side, written as a flat lockfile and read again. Directories are links, as npm writes
    them; npm's files have no unknown source, so that such a package has no URL there and is read as a remote one."""
    c = F.col
    packages = bridge.lock_packages(spark, d).dropDuplicates(["repo", "side", "key"])
    local, folder = c("source_kind") == "directory", F.concat(F.lit("vendor/"), "key")
    url = F.when(c("source_kind") == "git", F.lit("git+https://h.example/x.git")).when(c("source_kind") == "remote", F.lit("https://r.example/x.tgz")).when(local, folder)
    key = F.concat(F.lit("node_modules/"), "key", F.lit("/node_modules/"), "name")
    entry = F.struct(F.when(~local, c("version")).alias("version"), url.alias("resolved"), F.when(~local, c("integrity")).alias("integrity"), F.when(local, F.lit(True)).alias("link"), "dev")
    target = F.struct("version", *(F.lit(None).cast(t).alias(n) for n, t in [("resolved", "string"), ("integrity", "string"), ("link", "boolean"), ("dev", "boolean")]))
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    entries = F.when(local, F.array(pair(key, entry), pair(folder, target))).otherwise(F.array(pair(key, entry)))
    # One lockfile is one value by its nature; a repository's packages are what bounds it.
    files = packages.groupBy("repo", "side").agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("packages"))
    lockfile = F.to_json(F.struct(F.lit(3).alias("lockfileVersion"), "packages"))
    rows = lockfiles.read_lockfiles(files.select(F.concat_ws(":", F.col("repo").cast("string"), "side").alias("lockfile_id"), lockfile.alias("content")))
    return rows.select("lockfile_id", "key", "name", "version", "source_kind", "integrity", "dev")


Q["read_lockfiles"] = read_lockfiles
SQL["read_lockfiles"] = f"""SELECT DISTINCT repo || ':' || side AS lockfile_id, 'node_modules/' || key || '/node_modules/' || name AS key, name, version,
  CASE source_kind WHEN 'unknown' THEN 'remote' ELSE source_kind END AS source_kind, CASE WHEN source_kind IN ('remote', 'unknown') THEN integrity END AS integrity, dev
FROM ({bridge.duckdb(bridge.LOCK)})"""


def read_pnpm_lockfiles(spark, d):
    """The lock packages of each repository and side, written as pnpm writes them and read again."""
    c = F.col
    # Dealt out once, by file: repetitions, the texts and their lines are found where a file's packages are.
    packages = bridge.lock_packages(spark, d).withColumn("lockfile_id", F.concat_ws(":", c("repo").cast("string"), "side")).repartition("lockfile_id").dropDuplicates(["lockfile_id", "key"])
    key = F.concat(F.lit("  /"), "name", F.lit("@"), "version", F.lit("("), F.regexp_replace("key", "/", "-"), F.lit("):\n"))
    hashed = F.coalesce(F.concat(F.lit("integrity: "), "integrity", F.lit(", ")), F.lit(""))
    resolution = F.when(c("source_kind") == "git", "repo: https://h.example/x.git, commit: abc").when(c("source_kind") == "directory", "directory: ../local, type: directory").when(c("source_kind") == "unknown", "type: custom").otherwise(F.concat(hashed, F.lit("tarball: https://r.example/x.tgz")))
    entry = F.concat(key, F.lit("    resolution: {"), resolution, F.lit("}\n    engines: {node: '>=10'}\n    dependencies:\n      other: 1.0.0\n    dev: "), c("dev").cast("string"), F.lit("\n"))
    files = packages.groupBy("lockfile_id").agg(F.array_join(F.collect_list(entry), "\n").alias("entries"))
    content = F.concat(F.lit("lockfileVersion: '6.0'\n\nsettings:\n  autoInstallPeers: true\n\ndependencies:\n  p1:\n    specifier: ^1.0.0\n    version: 1.0.0\n\npackages:\n\n"), "entries")
    rows = lockfiles.read_pnpm_lockfiles(files.select("lockfile_id", content.alias("content")))
    return rows.select("lockfile_id", "key", "name", "version", "source_kind", "url", "integrity", "dev")


Q["read_pnpm_lockfiles"] = read_pnpm_lockfiles
SQL["read_pnpm_lockfiles"] = f"""SELECT DISTINCT repo || ':' || side AS lockfile_id, '/' || name || '@' || version || '(' || replace(key, '/', '-') || ')' AS key, name, version, source_kind,
  CASE source_kind WHEN 'git' THEN 'https://h.example/x.git#abc' WHEN 'directory' THEN '../local' WHEN 'unknown' THEN NULL ELSE 'https://r.example/x.tgz' END AS url, CASE WHEN source_kind = 'remote' THEN integrity END AS integrity, dev
FROM ({bridge.duckdb(bridge.LOCK)})"""


def snapshot_store(spark, d):
    """The recordings of the versions 1.2.0 pushed to an empty store, then all; the index read again and verified."""
    about = bridge.events(spark, d).groupBy("recording_id").agg(F.max("package").alias("package"), F.max("version").alias("version"))
    files = recordings.read_files(spark, _dropped(spark, d)).withColumn("recording_id", F.col("recording_id").cast("long"))
    contents = materialize(files.join(about, "recording_id").select("recording_id", "package", "version", "content"), "contents")
    store = SnapshotStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.push(contents.where("version = '1.2.0'"), "2026-01-01T00:00:00Z")
    store.push(contents, "2026-01-02T00:00:00Z")
    key = ["package", "version", "digest"]
    rows = store.index().join(store.verify().distinct(), key)
    return rows.select("append_pos", "package", "version", F.col("recording_id").cast("long").alias("recording_id"), "recorded_at", "observations", "error")


Q["snapshot_store"] = snapshot_store
SQL["snapshot_store"] = BASE + """SELECT row_number() OVER (ORDER BY recorded_at, recording_id) AS append_pos, package, version, recording_id, recorded_at, observations, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT *, '2026-01-01T00:00:00Z' AS recorded_at FROM a WHERE version = '1.2.0' AND NOT is_partial UNION ALL SELECT *, '2026-01-02T00:00:00Z' FROM a WHERE NOT is_partial)"""

DAY = 86_400_000_000
PULSES = dict(limit_us=4 * DAY, every=10, every_us=3 * DAY)
PULSE_SQL = f"""WITH RECURSIVE a AS (SELECT user_id AS recording_id, event_id AS arrival, epoch_us(ts) AS us FROM events
), x AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY us, arrival) AS n, lead(us) OVER (PARTITION BY recording_id ORDER BY us, arrival) AS next_us FROM a
), b(recording_id, beats, n, us) AS (
  SELECT recording_id, 0::BIGINT, 0::BIGINT, min(us) FROM x GROUP BY recording_id
  UNION ALL SELECT b.recording_id, b.beats + 1, min(x.n), min(x.us) FROM b JOIN x ON x.recording_id = b.recording_id AND x.n > b.n AND (x.n - b.n >= 10 OR x.us - b.us >= {3 * DAY}) GROUP BY b.recording_id, b.beats
), t AS (SELECT recording_id, count(*) AS n, max(us) AS last_us, recording_id % 3 = 0 AS ended FROM x GROUP BY recording_id
), now AS (SELECT max(last_us + CASE WHEN ended THEN 1 ELSE 0 END) AS us FROM t
), silent AS (
  SELECT recording_id, min(n) AS n FROM x WHERE next_us - us > {4 * DAY} GROUP BY recording_id
  UNION ALL SELECT recording_id, n FROM t, now WHERE NOT ended AND (last_us + {4 * DAY}) // 1000 + 1 < now.us // 1000
), dead AS (SELECT recording_id, min(n) AS n FROM silent GROUP BY recording_id)
SELECT recording_id, 'heartbeat' AS kind, beats, n AS events, us FROM b WHERE beats > 0
UNION ALL SELECT recording_id, 'ended', (SELECT max(beats) FROM b WHERE b.recording_id = t.recording_id), n, last_us + 1 FROM t WHERE ended
UNION ALL SELECT recording_id, 'dead', (SELECT max(beats) FROM b WHERE b.recording_id = dead.recording_id AND b.n <= dead.n), n, (SELECT us FROM x WHERE x.recording_id = dead.recording_id AND x.n = dead.n) FROM dead"""


def _beating(spark, d):
    """Arrivals, and an end a microsecond after the last of every third recording."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("user_id").alias("recording_id"), F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us"), F.col("event_id").alias("arrival"), F.lit(False).alias("is_end"))
    last = rows.where("recording_id % 3 = 0").groupBy("recording_id").agg((F.max("us") + 1).alias("us"), F.max("arrival").alias("arrival"))
    return rows.unionByName(last.withColumn("is_end", F.lit(True)))


def heartbeats(spark, d):
    return sessions.pulses_of(_beating(spark, d), **PULSES)


def heartbeats_live(spark, d):
    """As they arrive, in files that follow each other in time."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = materialize(_beating(spark, d).withColumn("time", F.timestamp_micros("us")), "beating")
    cuts = rows.select(F.percentile_approx("us", [0.25, 0.5, 0.75], 1000).alias("c")).first()["c"]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows.where((F.col("us") > low) if low is not None else F.lit(True)).where((F.col("us") <= high) if high is not None else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("time", "0 seconds")
    return live.run_once(sessions.pulses(stream, **PULSES), "append", folder)


Q["heartbeats"] = heartbeats
SQL["heartbeats"] = PULSE_SQL
Q["heartbeats_live"] = heartbeats_live
SQL["heartbeats_live"] = PULSE_SQL


def live_reports(spark, d):
    """Scores, verdicts and evidence as of the last batch of a stream."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = bridge.events(spark, d)
    last = events.where("has_end").groupBy("recording_id").agg(F.max("seq").alias("last"), F.max("complete").alias("complete"), F.min_by("backend", "seq").alias("backend"))
    ends = last.select("recording_id", (F.col("last") + 1).alias("seq"), F.lit("session_end").alias("op"), "complete", "backend")
    rows = materialize(events.drop("complete", "has_end").unionByName(ends, allowMissingColumns=True), "live-events")
    for k in range(3):
        rows.where(f"least(floor(seq / 20), 2) = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = sessions.live_reports(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sessions.upserts(f"{folder}/out")).start()
    query.awaitTermination()
    state = materialize(sessions.latest(spark, f"{folder}/out"), "live-latest")
    shown = state.where("rule_id is not null").groupBy("recording_id").agg(F.count(F.lit(1)).alias("findings"), F.sum(F.size("evidence")).alias("evidence"))
    return sessions.reports(state).join(shown, "recording_id", "left").fillna(0, ["findings", "evidence"])


Q["live_reports"] = live_reports
SQL["live_reports"] = BASE + """SELECT recording_id, observations, unresolved, backend, critical, high, medium, low, raw, value, is_partial, verdict, coalesce(findings, 0) AS findings, CAST(coalesce(evidence, 0) AS BIGINT) AS evidence
FROM a LEFT JOIN (SELECT recording_id, count(*) AS findings, sum(least(occurrences, 5)) AS evidence FROM f GROUP BY recording_id) USING (recording_id)"""
