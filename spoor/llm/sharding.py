"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the key. It starts as one bucket; only a
bucket over the byte limit splits on one more bit, until every bucket fits. Documents are summed
once into fine cells, the directory is worked out on those sums, and only cells that are still too
large are summed again on more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from spoor.llm.common import materialize

HASH_BITS = 60
LIMIT = 1 << 20


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document ``doc_id, n_bytes, shard, depth, shard_bytes, shard_docs``.

    n_bytes: UTF-8 bytes of the text, 0 for null. The hash is the first 60 bits of md5 of the id as
    text (a null id hashes as the empty string). shard: the bucket's prefix as a bit string ("" for
    the only one); ``depth`` its length. No shard exceeds ``limit`` bytes, except for one document
    that does so alone. Documents with one hash (rows of one id) cannot be split by bits: if they
    exceed the limit they fill overflow pages, in order of size, named prefix + "+" + page number.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
    )
    rows = materialize(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deepest = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    done, open_rows, lowest = [], rows, 0
    while True:
        cell = F.shiftright("hash", HASH_BITS - deepest)
        cells = materialize(open_rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "shard-cells")
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(lowest), F.lit(deepest))))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {deepest} - depth)"))
        nodes = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
        # The first level at which a cell's bucket fits is where splitting stopped.
        fits = materialize(fits, "shard-fits")
        # No bucket fits above the shallowest that does, so the few prefixes there, each of very many cells, stay out of the join.
        levels = levels.where(F.col("depth") >= (fits.agg(F.min("depth")).first()[0] or 0))
        # The directory grows with the data, so nothing of it is broadcast.
        of_cell = levels.join(fits.hint("merge"), ["depth", "prefix"]).groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_docs"), "depth").alias("leaf"))
        of_cell = materialize(of_cell, "shard-directory")
        done.append(open_rows.withColumn("cell", cell).join(of_cell.hint("merge"), "cell").select("doc_id", "n_bytes", "leaf.*", F.lit(None).cast("long").alias("page")))
        left = cells.join(of_cell.hint("merge"), "cell", "left_anti")
        if left.isEmpty():
            break
        open_rows = open_rows.withColumn("cell", cell).join(left.select("cell").hint("merge"), "cell", "left_semi").drop("cell")
        if deepest == HASH_BITS:
            done.append(_overflow(open_rows, limit))
            break
        open_rows = materialize(open_rows, "shard-open")
        lowest, deepest = deepest + 1, min(HASH_BITS, deepest + 6)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    name = F.concat(bits, F.coalesce(F.concat(F.lit("+"), F.col("page").cast("string")), F.lit("")))
    return out.select("doc_id", "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for documents that share their whole hash. Rows of one id and size are alike, so they
    are counted and dealt to pages by number: a page holds as many as fit the limit."""
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    groups = rows.groupBy("hash", "doc_id", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("pages", F.ceil(F.col("n") / per_page).cast("long"))
    first = F.sum("pages").over(Window.partitionBy("hash").orderBy("n_bytes", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("first", F.coalesce(first, F.lit(0)))
    # A repeated row goes to a random page of its group would not be bounded; number it within salted parts.
    pages = groups.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    share = F.least(per_page, F.col("n") - F.col("p") * per_page)
    rows_of = pages.withColumn("i", F.explode(F.sequence(F.lit(1), share)))
    return rows_of.select(
        "doc_id", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("hash").alias("prefix"), (share * F.col("n_bytes")).alias("shard_bytes"), share.alias("shard_docs"), (F.col("first") + F.col("p")).alias("page")
    )
