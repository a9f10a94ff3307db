"""Recordings as they arrive: ingest, running findings, and order with late events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spoor.catalog import Catalog
from spoor.operators import rules
from spoor.sources.recordings import parse_lines

#: A stream holds back so many records at most before it releases the oldest.
PENDING = 16_384


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks, each many of them; Spark makes a task a folder, again for every batch of a stream."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_ingest(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New files of JSON lines as they are dropped below ``path``, with the refusal rules of the batch reader."""
    with few_listing_tasks(spark):
        files = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).option("wholetext", "true").text(path)
    named = F.regexp_extract(F.col("_metadata.file_path"), "recording_id=([^/]+)/", 1)
    lines = files.select(named.alias("recording_id"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    return parse_lines(lines.select("recording_id", (F.col("pos") + 1).cast("long").alias("seq"), "line"))


def live_findings(events: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Running count of every finding of a stream of events (update or complete mode): the state is a row per finding."""
    catalog = catalog or Catalog()
    found = rules.match_rules(rules.hits(events, catalog), catalog)
    return found.groupBy("recording_id", "rule_id", "subject").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("sev_rank", "severity")).alias("w")).select("recording_id", "rule_id", "subject", "occurrences", "w.severity")


def live_state(events: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """The running findings, and per recording one row without a rule: the events so far, and of its last session_end
    whether it said complete (null until it arrives)."""
    catalog = catalog or Catalog()
    c = F.col
    found = rules.match_rules(rules.hits(events, catalog), catalog).select("recording_id", "rule_id", "subject", F.struct("sev_rank", "severity").alias("w"), F.lit(None).cast("boolean").alias("ended"), F.lit(None).cast("long").alias("at"))
    none = F.lit(None).cast("string")
    end = c("op") == "session_end"
    seen = events.select("recording_id", none.alias("rule_id"), none.alias("subject"), F.lit(None).cast("struct<sev_rank: int, severity: string>").alias("w"), F.when(end, c("complete")).alias("ended"), F.when(end, c("seq")).alias("at"))
    return found.unionByName(seen).groupBy("recording_id", "rule_id", "subject").agg(F.count(F.lit(1)).alias("occurrences"), F.min("w").alias("w"), F.max_by("ended", "at").alias("ended")).select("recording_id", "rule_id", "subject", "occurrences", "w.severity", "ended")


def live_scores(state: DataFrame) -> DataFrame:
    """Per recording of a ``live_state`` its score so far; it is partial until an end has said that it is complete."""
    recordings = state.where("rule_id is null").select("recording_id", (~F.coalesce("ended", F.lit(False))).alias("is_partial"))
    return rules.scores(recordings.select("recording_id"), state.where("rule_id is not null")).join(recordings, "recording_id")


RELEASED = "recording_id long, us long, arrival long, late boolean"
STATE = "us array<long>, arrival array<long>, newest long, released long"


def reorder_window(arrivals: DataFrame, window_us: int, pending: int = PENDING) -> DataFrame:
    """A stream ``recording_id, us, arrival`` released in order of time, ``window_us`` behind the newest record.

    What is older than the last one released is emitted all the same, marked late. At most ``pending`` records
    wait per recording; the oldest of more are released early. A record whose time is null ends the recording:
    what still waits comes out and the state goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, arrival, newest, released = state.get if state.exists else ([], [], -(1 << 62), -(1 << 62))
        waiting = list(zip(us, arrival, strict=True))
        out = []

        def let_go(until: int) -> None:
            nonlocal waiting, released
            waiting.sort()
            n = next((k for k, w in enumerate(waiting) if w[0] > until), len(waiting))
            n = max(n, len(waiting) - pending)
            for u, a in waiting[:n]:
                out.append((key[0], u, a, False))
                released = max(released, u)
            waiting = waiting[n:]

        rows = sorted((int(a), None if pd.isna(u) else int(u)) for b in batches for a, u in zip(b["arrival"], b["us"], strict=True))
        ended = False
        for a, u in rows:
            if u is None:
                let_go(1 << 62)
                ended = True
            elif u < released:
                out.append((key[0], u, a, True))
            else:
                waiting.append((u, a))
                newest = max(newest, u)
                let_go(newest - window_us)
        if ended and not waiting:
            state.remove()
        else:
            state.update(([w[0] for w in waiting], [w[1] for w in waiting], newest, released))
        yield pd.DataFrame(out, columns=["recording_id", "us", "arrival", "late"])

    return arrivals.groupBy("recording_id").applyInPandasWithState(step, RELEASED, STATE, "append", GroupStateTimeout.NoTimeout)


VOLUME = "recording_id long, pid long, fd long, path string, bytes long, writes long, last_us long"


def stateful_write_volume(activity: DataFrame) -> DataFrame:
    """A stream ``recording_id, pid, fd, seq, us, act, path, bytes`` to what was written through each descriptor from an open
    to the next open or close, whatever its path: a row when it ends. Writes without an open file are emitted one by
    one, without a path. An act ``end`` flushes what is open. The state of a descriptor is one open file."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        path, total, writes, last = state.get if state.exists else (None, 0, 0, 0)
        out = []
        rows = sorted((r for b in batches for r in b[["seq", "us", "act", "path", "bytes"]].itertuples(index=False)), key=lambda r: r.seq)
        for r in rows:
            if r.act == "write":
                size = 0 if pd.isna(r.bytes) else int(r.bytes)
                if path is None:
                    out.append((*key, None, size, 1, int(r.us)))
                else:
                    total, writes, last = total + size, writes + 1, int(r.us)
            else:
                if path is not None and writes:
                    out.append((*key, path, total, writes, last))
                path, total, writes, last = (r.path if r.act == "open" else None), 0, 0, 0
        if path is None:
            if state.exists:
                state.remove()
        else:
            state.update((path, total, writes, last))
        yield pd.DataFrame(out, columns=["recording_id", "pid", "fd", "path", "bytes", "writes", "last_us"])

    return activity.where("act in ('open', 'write', 'close', 'end')").groupBy("recording_id", "pid", "fd").applyInPandasWithState(step, VOLUME, "path string, bytes long, writes long, last long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a stream over everything that is there and read what its last state is (each batch replaces the one before)."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    with few_listing_tasks(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
