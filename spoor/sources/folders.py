"""Folders of very many small files.

Where a folder lies in a file system that all executors mount (``file:``), its files are written and read with plain calls: Hadoop's
classes start a process for the permissions of each file and folder they make, and Spark's index holds an entry of each file in the driver.
Any other store, compressed files and files over ``LARGE`` go through Spark's own readers and writers.
"""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spoor.scratch import materialize

#: Bytes from which a file is read by Spark, in ranges.
LARGE = 16 << 20
#: Bytes and rows of what is handed to Spark at once.
BATCH, ROWS = 4 << 20, 10_000
COMPRESSED = (".gz", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate")
#: What Hive's names of folders do not hold as it is.
ESCAPED = re.compile("[\x00-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
#: What Spark's names of files show as codes, and what means something in the paths it is given.
URI, GLOB = re.compile("[\x00-\x20\"#%<>?\\[\\\\\\]^`{|}\x7f]"), re.compile(r"[*?{}\[\]\\]")


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path for plain calls, if it lies in a file system of that kind."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return whole.getPath() if whole.getScheme() == "file" and not re.search(r"[*?{\[]", path) else None


def _parts(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def write_tree(rows: DataFrame, path: str, by: list[str], order: Column | str) -> None:
    """Column ``value`` of ``rows`` as the lines of one file for each value of ``by``, in folders ``by=value``, sorted by ``order``."""
    # By a hash of its own: a union that is dealt out by the same columns already would not be dealt out anew, and its parts not be put together.
    dealt = rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, order)
    root = mounted(rows.sparkSession, path)
    if root is None:
        dealt.select(*by, "value").write.partitionBy(*by).text(path)
        return
    os.makedirs(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, aside, made = None, None, None, 0

        def close() -> None:
            if out:
                out.close()
                os.replace(aside, aside.rpartition("/")[0] + "/part-00000.txt")

        for batch in batches:
            *keys, lines = (c.to_pylist() for c in batch.columns)
            for key, line in zip(zip(*keys, strict=True), lines, strict=True):
                if key != at:
                    close()
                    names = ["__HIVE_DEFAULT_PARTITION__" if v in (None, "") else ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) for v in key]
                    folder = "/".join([root, *(f"{k}={v}" for k, v in zip(by, names, strict=True))])
                    os.makedirs(folder, exist_ok=True)
                    at, aside, made = key, f"{folder}/.{uuid.uuid4().hex}", made + 1
                    out = open(aside, "wb")
                out.write(line + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": [made]})

    texts = dealt.select(*(F.col(c).cast("string").alias(c) for c in by), F.coalesce("value", F.lit("")).cast("binary").alias("value"))
    texts.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def _listed(spark: SparkSession, root: str, files: str | None) -> DataFrame:
    """``file, size`` of what Spark would read (so no empty files) below ``root``; what lies directly in it is told to the executors, which look into the folders."""
    shown = lambda name: not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))
    top = [e for e in os.scandir(root) if shown(e.name)] if os.path.isdir(root) else []
    tops = [e.path for e in top] if os.path.isdir(root) else [root]
    shown_files = lambda names: [n for n in names if shown(n) and (files is None or fnmatch.fnmatchcase(n, files))]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                if not os.path.isdir(path):
                    found += [path] if shown_files([os.path.basename(path)]) else []
                for folder, folders, names in os.walk(path):
                    folders[:] = [f for f in folders if shown(f)]
                    found += [f"{folder}/{n}" for n in shown_files(names)]
            for k in range(0, len(found), ROWS):
                yield pa.RecordBatch.from_pydict({"file": found[k : k + ROWS], "size": [os.path.getsize(f) for f in found[k : k + ROWS]]})

    rows = spark.createDataFrame([(t,) for t in tops], "path string").repartition(_parts(spark))
    return materialize(rows.mapInArrow(look, "file string, size long"), "files")


def _split(spark: SparkSession, path: str, files: str | None) -> tuple[DataFrame | None, list[str] | None]:
    """The small files (``file, size``), and the paths that Spark reads; of these None stands for all of ``path``."""
    root = mounted(spark, path)
    if root is None or files and not re.fullmatch(r"[\w.*?-]+", files):
        return None, None
    listed = _listed(spark, root, files)
    left = (F.col("size") > LARGE) | F.lower("file").rlike("(" + "|".join(map(re.escape, COMPRESSED)) + ")$")
    return listed.where(~left & (F.col("size") > 0)).repartition(_parts(spark)), ["file://" + GLOB.sub(r"\\\g<0>", r.file) for r in listed.where(left).select("file").collect()]


def _batched(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > BATCH or len(held) >= ROWS:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for file in batch.column(0).to_pylist():
            with open(file, "rb") as f:
                yield "file:" + URI.sub(lambda m: f"%{ord(m[0]):02X}", file), f.read()


def small_lines(spark: SparkSession, path: str, files: str | None) -> tuple[DataFrame | None, list[str] | None]:
    """``file, line_no, line`` of the small files, and the paths that are left, as ``_split`` gives them."""
    small, left = _split(spark, path, files)
    if small is None:
        return None, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple[str, int, bytes]]:
            for file, text in _texts(batches):
                found = text.removeprefix(b"\xef\xbb\xbf").split(b"\n")
                yield from ((file, n, x) for n, x in enumerate(found if found[-1] else found[:-1], 1))

        yield from _batched(lines(), ["file", "line_no", "line"])

    return small.mapInArrow(run, "file string, line_no long, line binary").withColumn("line", F.col("line").cast("string")), left


def whole_files(spark: SparkSession, path: str, files: str | None = None) -> DataFrame:
    """``file, content``: the text of each file below ``path`` (of those whose names match ``files``)."""
    small, left = _split(spark, path, files)
    found = None
    if small is not None:
        found = small.mapInArrow(lambda batches: _batched(_texts(batches), ["file", "content"]), "file string, content binary").withColumn("content", F.col("content").cast("string"))
        if not left:
            return found
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", files) if files else reader
    by_spark = reader.text(left or path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return by_spark if found is None else found.unionByName(by_spark)
