"""Lines of text files with their numbers, whatever the size of a file.

Spark reads a file in byte ranges, each by a task of its own. How many lines begin in each range gives the number of
the first of the next, so no file is ever one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spoor.scratch import materialize
from spoor.sources.folders import small_lines


def numbered_lines(spark: SparkSession, path: str, files: str | None = None) -> DataFrame:
    """``file, line_no, line`` of all files below ``path`` (of those whose names match ``files``). Lines end with a line feed; a carriage
    return before it stays. Compressed files are one range each.

    The lines are written once with the range they begin in and their place in the task that read it: a range's lines are
    neighbours there. A second reading could find other ranges, as these depend on the executors there are. Small files in a folder
    that all executors mount are read whole and counted where they are read.
    """
    small, left = small_lines(spark, path, files)
    if small is None:
        return _ranged(spark, path, files)
    return small.unionByName(_ranged(spark, left, files)) if left else small


def _ranged(spark: SparkSession, path: str | list[str], files: str | None) -> DataFrame:
    c = F.col
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    reader = reader.option("pathGlobFilter", files) if files else reader
    found = reader.text(path).select(c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("place"), c("value").alias("line"))
    rows = materialize(found, "lines")
    ranges = rows.groupBy("file", "begin").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("file", "begin", (F.coalesce(before, F.lit(0)) - c("first") + 1).alias("shift"))
    return rows.join(ranges, ["file", "begin"]).select("file", (c("place") + c("shift")).alias("line_no"), "line")
