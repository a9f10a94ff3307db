"""Recordings as JSON lines: one object per line, one file per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spoor.scratch import materialize
from spoor.sources.folders import whole_files, write_tree
from spoor.sources.lines import numbered_lines

SCHEMA_VERSION = 1
#: The kinds of lines.
OPS = ["session_start", "fs_write", "fs_read", "net_connect", "dns_query", "proc_spawn", "heartbeat", "session_end"]
PATH = "STRUCT<path: STRING, origin: STRING>"
#: The fields of a line. A heartbeat's own seq is read as hb_seq.
EVENT = (
    "schema_version INT, ts_ns BIGINT, pid BIGINT, syscall STRING, backend STRING, op STRING, ok BOOLEAN, error STRING, "
    f"target {PATH}, source {PATH}, kind STRING, bytes BIGINT, flags STRING, mode STRING, family STRING, ip STRING, port INT, unix_path STRING, host STRING, "
    "loopback BOOLEAN, private BOOLEAN, qname STRING, qtype INT, resolver_ip STRING, bin STRING, argv ARRAY<STRING>, argv_truncated BOOLEAN, wall_clock_utc STRING, agent_version STRING, "
    "command ARRAY<STRING>, zones STRUCT<project: STRING, cache: STRING, home: STRING, tmp: STRING, extra: ARRAY<STRING>>, events_so_far BIGINT, phase STRING, "
    "complete BOOLEAN, incomplete_reasons ARRAY<STRING>, command_exit_code INT, command_signal INT, duration_ns BIGINT, events_emitted BIGINT, heartbeats BIGINT"
)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Rows ``recording_id, seq, line`` to events with ``reject``, the reason why a line is refused, null if it is not."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    rows = lines.withColumn("e", F.from_json("line", EVENT + ", _malformed STRING", options))
    rows = rows.select("recording_id", "seq", "e.*")
    reject = (
        F.when(F.col("_malformed").isNotNull(), "malformed line")
        .when(F.col("schema_version").isNull() | (F.col("schema_version") != SCHEMA_VERSION), "unsupported schema version")
        .when(F.col("op").isNull() | ~F.col("op").isin(OPS), "unknown op")
    )
    return rows.withColumn("reject", reject).drop("_malformed").withColumn("argv", F.coalesce("argv", F.array().cast("array<string>")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``recording_id, content``: the whole text of each file. A file below a folder ``recording_id=x`` belongs to x,
    any other to its own path."""
    named = F.regexp_extract("file", "recording_id=([^/]+)/", 1)
    return whole_files(spark, path).select(F.when(named != "", named).otherwise(F.col("file")).alias("recording_id"), "content")


def read_lines(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """``recording_id, seq, line``: the lines of all files with their number in the file, blank ones left out. Packed files
    (``write_recordings``) carry the numbers; for others they are worked out."""
    if packed:
        parts = F.split("value", "\t", 3)
        return spark.read.option("recursiveFileLookup", "true").text(path).select(parts[0].alias("recording_id"), parts[1].cast("long").alias("seq"), parts[2].alias("line"))
    named = F.regexp_extract("file", "recording_id=([^/]+)/", 1)
    rows = numbered_lines(spark, path).where(F.trim(F.regexp_replace("line", "\r$", "")) != "")
    return rows.select(F.when(named != "", named).otherwise(F.col("file")).alias("recording_id"), F.col("line_no").alias("seq"), F.regexp_replace("line", "\r$", "").alias("line"))


def read_recordings(spark: SparkSession, path: str, on_error: str = "fail", packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events and refused lines. One bad line refuses its whole recording: with ``fail`` an error is raised,
    with ``quarantine`` the recording is left out and its bad lines are returned. Lines are parsed once and written."""
    rows = materialize(parse_lines(read_lines(spark, path, packed)), "recordings-parsed")
    bad = rows.where(F.col("reject").isNotNull()).select("recording_id", "seq", "reject")
    if on_error == "fail":
        if first := bad.head(1):
            raise ValueError(f"{first[0].recording_id}, line {first[0].seq}: {first[0].reject}")
        return rows.drop("reject"), bad
    return rows.join(bad.select("recording_id").distinct(), "recording_id", "left_anti").drop("reject"), bad


def write_recordings(events: DataFrame, path: str, packed: bool = False) -> None:
    """One folder per recording, its lines in order; null fields are left out. Packed: many recordings a file, each line
    behind its recording and number, for corpora of more recordings than a file system likes folders."""
    fields = [c for c in events.columns if c not in ("recording_id", "seq")]
    lines = events.select("recording_id", "seq", F.to_json(F.struct(*fields)).alias("value"))
    if packed:
        lines.repartition("recording_id").sortWithinPartitions("recording_id", "seq").select(F.concat_ws("\t", F.col("recording_id").cast("string"), F.col("seq").cast("string"), "value")).write.text(path)
        return
    write_tree(lines, path, ["recording_id"], "seq")


def lines_of(bridge: DataFrame) -> DataFrame:
    """Bridge events in the shape of recordings, with a first and, where it has one, a last line."""
    c = F.col
    body = bridge.select(
        "recording_id",
        "seq",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "ts_ns",
        c("pid").cast("long").alias("pid"),
        "backend",
        "op",
        "ok",
        "error",
        F.when(c("path").isNotNull(), F.struct("path", "origin")).alias("target"),
        "kind",
        "bytes",
        "mode",
        "ip",
        c("port").cast("int").alias("port"),
        "unix_path",
        F.when(c("op") == "net_connect", c("loopback")).alias("loopback"),
        F.when(c("op") == "net_connect", c("private")).alias("private"),
        "qname",
        "bin",
        F.when(F.size("argv") > 0, c("argv")).alias("argv"),
        F.when(c("op") == "proc_spawn", c("argv_truncated")).alias("argv_truncated"),
    )
    zones = F.struct(c("zone_project").alias("project"), c("zone_cache").alias("cache"), c("zone_home").alias("home"), c("zone_tmp").alias("tmp"), c("extra").alias("extra"))
    about = bridge.groupBy("recording_id").agg(F.min_by(zones, "seq").alias("zones"), F.min_by("backend", "seq").alias("backend"), F.max("complete").alias("complete"), F.max("has_end").alias("has_end"), F.max("seq").alias("n"), F.max("ts_ns").alias("end"), F.max("agent_version").alias("agent_version"))
    start = about.select("recording_id", F.lit(0).cast("long").alias("seq"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(0).cast("long").alias("ts_ns"), "backend", F.lit("session_start").alias("op"), "zones", "agent_version", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + c("recording_id").cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("wall_clock_utc"))
    end = about.where("has_end").select("recording_id", (c("n") + 1).alias("seq"), F.lit(SCHEMA_VERSION).alias("schema_version"), c("end").alias("ts_ns"), "backend", F.lit("session_end").alias("op"), "complete", c("n").alias("events_emitted"), (c("n") % 3).cast("int").alias("command_exit_code"), F.when(~c("complete"), F.array(F.lit("interrupted"))).alias("incomplete_reasons"))
    return body.unionByName(start, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)


def incomplete_reason(reason: Column) -> Column:
    """An externally tagged reason in the words of the reference; other text stays."""
    get = lambda path: F.get_json_object(reason, "$." + path)
    return (
        F.when(reason == "interrupted", "recording interrupted")
        .when(get("backend_failed_to_start").isNotNull(), F.concat(F.lit("recorder backend failed to start: "), get("backend_failed_to_start.detail")))
        .when(get("backend_died").isNotNull(), F.concat(F.lit("recorder backend died: "), get("backend_died.detail")))
        .when(get("timeout").isNotNull(), F.concat(F.lit("exceeded "), get("timeout.limit_secs"), F.lit("s time limit")))
        .when(get("event_cap_reached").isNotNull(), F.concat(F.lit("event cap of "), get("event_cap_reached.cap"), F.lit(" reached; stream is truncated")))
        .when(get("parse_errors").isNotNull(), F.concat(get("parse_errors.count"), F.lit(" unparseable trace lines")))
        .when(get("trace_truncated").isNotNull(), F.concat(F.lit("trace output truncated: "), get("trace_truncated.detail")))
        .otherwise(F.coalesce(get("other.detail"), reason))
    )


def attach_session(events: DataFrame) -> DataFrame:
    """Events of recordings with what frames them: zones of the first start, backend of the first event,
    completeness of the last end. Only framing rows are aggregated."""
    c = F.col
    start = F.min_by("zones", F.when(c("op") == "session_start", c("seq")))
    about = events.groupBy("recording_id").agg(
        start.alias("z"),
        F.min_by("backend", "seq").alias("first_backend"),
        F.max_by("complete", F.when(c("op") == "session_end", c("seq"))).alias("end_complete"),
        F.transform(F.max_by("incomplete_reasons", F.when(c("op") == "session_end", c("seq"))), incomplete_reason).alias("incomplete_reasons"),
        F.max((c("op") == "session_end").cast("int")).cast("boolean").alias("has_end"),
    )
    rows = events.drop("zones", "complete", "backend", "incomplete_reasons").join(about, "recording_id")
    return rows.select(
        "recording_id", "seq", "ts_ns", "pid", "op", "ok", "error", c("target.path").alias("path"), c("target.origin").alias("origin"), "kind", "bytes", "mode", "ip", "port", "unix_path", "loopback", "private", "qname", "bin", "argv",
        F.coalesce("argv_truncated", F.lit(False)).alias("argv_truncated"), c("z.project").alias("zone_project"), c("z.cache").alias("zone_cache"), c("z.home").alias("zone_home"), c("z.tmp").alias("zone_tmp"),
        F.coalesce(c("z.extra"), F.array().cast("array<string>")).alias("extra"), c("first_backend").alias("backend"), F.coalesce("end_complete", F.lit(False)).alias("complete"), "has_end", "incomplete_reasons",
    )


def stream_summary(events: DataFrame) -> DataFrame:
    """Per recording: events, heartbeats, completeness with its reasons, the command's exit code; one without an end has the error set."""
    c = F.col
    end = F.when(c("op") == "session_end", c("seq"))
    rows = events.groupBy("recording_id").agg(
        F.count(F.when(~c("op").isin("session_start", "session_end", "heartbeat"), 1)).alias("events"),
        F.count(F.when(c("op") == "heartbeat", 1)).alias("heartbeats"),
        F.coalesce(F.max_by("complete", end), F.lit(False)).alias("complete"),
        F.max((c("op") == "session_start").cast("int")).cast("boolean").alias("has_session_start"),
        F.when(F.max(end).isNull(), "no session_end").alias("error"),
        F.max_by("command_exit_code", end).alias("exit_code"),
        F.array_join(F.transform(F.max_by("incomplete_reasons", end), incomplete_reason), "; ").alias("reasons"),
    )
    return rows


def stream_facts(events: DataFrame) -> DataFrame:
    """Per recording what its framing lines say for the index: start, agent and completeness by the last line that says
    so, the backend of the first line, and how many observations there are."""
    c = F.col
    end, start = (F.when(c("op") == op, c("seq")) for op in ("session_end", "session_start"))
    return events.groupBy("recording_id").agg(
        F.coalesce(F.max_by("wall_clock_utc", start), F.lit("")).alias("recorded_at"),
        F.coalesce(F.max_by("agent_version", start), F.lit("")).alias("agent_version"),
        F.coalesce(F.min_by("backend", "seq"), F.lit("unknown")).alias("backend"),
        F.count(F.when(~c("op").isin("session_start", "session_end", "heartbeat"), 1)).alias("events"),
        F.coalesce(F.max_by("complete", end), F.lit(False)).alias("complete"),
        F.coalesce(F.transform(F.max_by("incomplete_reasons", end), incomplete_reason), F.array().cast("array<string>")).alias("incomplete_reasons"),
    )


def union_streams(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Recordings of several sources together: every line says its version and backend itself, and a source
    without some column has nulls there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def read_run_results(spark: SparkSession, path: str, name: str = "recording.json") -> tuple[DataFrame, DataFrame]:
    """The result files below ``path``, whatever their folders: results with their fields and file, and the files that cannot
    be read or lack package or version, with the reason. None is left out."""
    kind = "package STRING, version STRING, started_at STRING, complete BOOLEAN, recorded BOOLEAN, events BIGINT, pushed BOOLEAN, exit_code INT, _malformed STRING"
    files = whole_files(spark, path, name)
    rows = files.select(F.col("file").alias("path"), F.from_json("content", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}).alias("r")).select("path", "r.*")
    error = F.when(F.col("_malformed").isNotNull(), "not valid JSON").when(F.col("package").isNull() | F.col("version").isNull(), "missing package or version")
    rows = rows.withColumn("error", error)
    return rows.where("error is null").drop("error", "_malformed"), rows.where("error is not null").select("path", "error")
