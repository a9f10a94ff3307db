"""A store of recordings: contents once under their digest, and an index in order of appending.

A push writes what is new to folders of its own, then commits by creating the next numbered file of the log, which names them. A
file system creates a file once, so of two pushes that meet one has to start again, now knowing what the other brought. What no
commit names is never read: a push that dies leaves nothing that counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spoor.operators import corpus
from spoor.scratch import materialize

INDEX = "append_pos long, package string, version string, digest string, recording_id string, events long, recorded_at string"
BLOBS = "digest string, content string"


class SnapshotStore:
    """``SnapshotStore(spark, root).push(contents, recorded_at)``; ``root`` is any folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def commits(self) -> list[dict]:
        """The log in order: for each push its number, folder, entries and the position of the first."""
        if not self._fs.exists(self._path("log")):
            return []
        rows = self.spark.read.text(f"{self.root}/log", wholetext=True).collect()  # a row per push, of a hundred bytes
        return sorted((json.loads(r.value) for r in rows), key=lambda c: c["number"])

    def _of(self, commits: list[dict], what: str, schema: str) -> DataFrame:
        folders = [f"{self.root}/{what}/{c['folder']}" for c in commits]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def index(self) -> DataFrame:
        """Every accepted recording ever pushed, in order of ``append_pos`` from 1 on, without gaps."""
        return self._of(self.commits(), "index", INDEX)

    def blobs(self) -> DataFrame:
        """Every content once, by its digest."""
        return self._of(self.commits(), "blobs", BLOBS)

    def verify(self) -> DataFrame:
        """Each entry read again: its observations, or why it fails."""
        commits = self.commits()
        return corpus.snapshot_verify(self._of(commits, "index", INDEX), self._of(commits, "blobs", BLOBS))

    def push(self, contents: DataFrame, recorded_at: str) -> DataFrame:
        """Appends the complete recordings of ``contents`` (recording_id, package, version, content). Returns a row per recording:
        refused with its reasons, or accepted with its digest, and ``stored`` where it brought the content. An error or a lost
        race leaves no trace in the store."""
        while True:
            commits, folder = self.commits(), uuid.uuid4().hex
            try:
                decided, entries = self._stage(contents, recorded_at, commits, folder)
                number = len(commits)
                commit = {"number": number, "folder": folder, "first": 1 + sum(c["entries"] for c in commits), "entries": entries}
                if self._commit(number, json.dumps(commit)):
                    return decided
            except BaseException:
                self._abort(folder)
                raise
            self._abort(folder)

    def _stage(self, contents: DataFrame, recorded_at: str, commits: list[dict], folder: str) -> tuple[DataFrame, int]:
        decided = materialize(corpus.snapshot_push(contents, self._of(commits, "blobs", BLOBS)), "store-push")
        new = decided.where("stored").select("recording_id", "digest")
        contents.join(new, "recording_id").select("digest", "content").write.option("compression", "zstd").parquet(f"{self.root}/blobs/{folder}")
        # Positions: ranges of recordings in order, and the sums of the ranges before.
        taken = decided.where("accepted").repartitionByRange("recording_id").withColumn("part", F.spark_partition_id())
        taken = materialize(taken, "store-entries")
        before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = taken.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
        place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("recording_id")) + sum(c["entries"] for c in commits)
        rows = taken.join(parts, "part").select(place.cast("long").alias("append_pos"), "package", "version", "digest", F.col("recording_id").cast("string").alias("recording_id"), "events", F.lit(recorded_at).alias("recorded_at"))
        rows.write.option("compression", "zstd").parquet(f"{self.root}/index/{folder}")
        return decided, taken.count()

    def _commit(self, number: int, text: str) -> bool:
        """Whether this push is the ``number``-th: the file is written aside and takes its name only if nobody has it."""
        aside = self._path("staged", uuid.uuid4().hex)
        out = self._fs.create(aside, False)
        out.write(text.encode())
        out.close()
        self._fs.mkdirs(self._path("log"))
        place = self._path("log", f"{number:012d}")
        won = not self._fs.exists(place) and self._fs.rename(aside, place)
        if not won:
            self._fs.delete(aside, False)
        return won

    def _abort(self, folder: str) -> None:
        for what in ("blobs", "index"):
            self._fs.delete(self._path(what, folder), True)

    def clear_aborted(self) -> int:
        """Removes the folders that no commit names, as pushes that died leave them; not while others push. Returns how many."""
        kept, gone = {c["folder"] for c in self.commits()}, 0
        for what in ("blobs", "index"):
            if self._fs.exists(self._path(what)):
                for entry in self._fs.listStatus(self._path(what)):
                    if entry.getPath().getName() not in kept:
                        gone += bool(self._fs.delete(entry.getPath(), True))
        return gone
