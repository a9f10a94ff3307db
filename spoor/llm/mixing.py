"""Mixing sources to target weights.

Every document gets a random key from a hash. Within its source the keys are sorted by range: the
leading bits of the key name the range, each range is summed, the ranges' sums are added up, and
only then the rows of one range are put in order. So a source of any size is dealt over many tasks,
and the cut falls at the exact word of the source's budget. Budgets over the source's size repeat it
in epochs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoor.llm.common import materialize, word_count

SHARE = 1.5
REPEAT = 2
WEIGHTS = (3, 1, 2)
#: Rows of a range, about.
RANGE_ROWS = 100_000
KEY_BITS = 60


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """Rows ``source, source_size`` to ``source, source_size, weight, target``.

    Sources in order of code points, null last, weigh as ``weights`` repeats. Targets share
    ``share`` of all words by weight; one that exceeds ``repeat`` times its source stops there and
    the excess is shared by weight among the rest, until none is above. Each round is one aggregate
    over the table of sources; at least one more source is capped in each, and few rounds are needed
    as what is handed on shrinks.
    """
    # Binary order of UTF-8 is the order of code points. The table has a row per source, not per document.
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * float(repeat)
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"] * share
    level, capped = 0.0, None
    while True:
        over = F.col("weight") * level >= cap if capped is not None else F.lit(False)
        held, free, n = ranked.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == capped or not free:
            break
        level, capped = max(0.0, total - held) / free, n
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level))


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size`` and the random place of a document in its source: key, then id, then
    ``tie``, a hash of the text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), place_of(seed).alias("place"), word_count(F.col("text")).alias("size"))


def place_of(seed: int) -> Column:
    """The place of a document in its source: ordered by 60 bits of md5 of seed and id."""
    doc_id = F.col("doc_id").cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.struct(F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"), doc_id.alias("id"), F.xxhash64("text").alias("tie"))


def cuts(rows: DataFrame) -> DataFrame:
    """Per source where its mix ends: ``source, source_size, target, epochs, cut, part``. Its
    documents are taken ``epochs`` times, those before the place ``cut`` once more, and ``part`` words
    of each at it (several only if they have the same id and text)."""
    sources = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    bits = max(0, math.ceil(math.log2(max(1, (sources.agg(F.max("n")).first()[0] or 0) / RANGE_ROWS)))) + 3
    wanted = targets(sources.drop("n"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    wanted = wanted.select("source", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    wanted = materialize(wanted, "mix-targets")

    # Rows that repeat are one unit: it is counted, not listed.
    units = rows.groupBy("source", "place", "size").agg(F.count(F.lit(1)).alias("n")).where("size > 0")
    units = units.withColumn("range", F.shiftright(F.col("place.key"), KEY_BITS - bits)).withColumn("all", F.col("size") * F.col("n"))
    sums = units.groupBy("source", "range").agg(F.sum("all").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "range", "range_size", F.coalesce(before, F.lit(0)).alias("ahead"))
    # Only the range in which the budget ends has to be sorted.
    w = wanted.select(F.col("source").alias("s"), "rest")
    sums = sums.join(w, sums["source"].eqNullSafe(w["s"])).drop("s").where("ahead <= rest and rest < ahead + range_size")
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), "ahead", "rest")
    last = units.join(sums, units["source"].eqNullSafe(sums["s"]) & (units["range"] == sums["r"])).drop("s", "r")
    end = F.col("ahead") + F.sum("all").over(Window.partitionBy("source", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = last.withColumn("end", end).where("end - all <= rest and rest < end")
    last = last.select(F.col("source").alias("s"), F.col("place").alias("cut"), F.floor((F.col("rest") - F.col("end") + F.col("all")) / F.col("n")).cast("long").alias("part"))
    out = wanted.join(last, wanted["source"].eqNullSafe(last["s"]), "left").drop("s", "rest")
    return materialize(out, "mix-cuts")


def once_more(place: Column, size: Column) -> Column:
    """Words taken beyond the whole epochs."""
    return F.when(place < F.col("cut"), size).when(place == F.col("cut"), F.col("part")).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken, source``.

    size: words of the text, 0 for null. taken: words the mix takes of it, repeats counted; only the
    document on which the budget ends is taken in part. Rows that repeat (same id and text) share
    what falls to them evenly, to the word. A null source is one source, the last in order. A
    source without words has target 0. An empty table gives an empty one.
    """
    rows = materialize(keyed(docs, seed), "mix-sizes")
    at = cuts(rows)
    joined = rows.join(at.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(F.col("s")))
    taken = F.col("epochs") * F.col("size") + once_more(F.col("place"), F.col("size"))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space kept."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(ends, 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix as documents with the columns of ``docs``: each once per epoch, and the one on which
    the budget ends up to its last word taken. Documents of which nothing is taken go, those
    without words among them. Texts are not shuffled: the cuts are one row per source."""
    own = keyed(docs, seed)
    at = cuts(materialize(own, "mix-sizes")).select(*[F.col(c).alias(f"_{c}") for c in ("source", "epochs", "cut", "part")])
    rows = docs.select("*", place_of(seed).alias("_place"), word_count(F.col("text")).alias("_size"))
    rows = rows.join(at, F.col("source").cast("string").eqNullSafe(F.col("_source")))
    more = F.when(F.col("_place") < F.col("_cut"), F.col("_size")).when(F.col("_place") == F.col("_cut"), F.col("_part")).otherwise(F.lit(0))
    takes = F.concat(F.array_repeat(F.col("_size"), F.col("_epochs").cast("int")), F.when(more > 0, F.array(more.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.where("_size > 0").withColumn("_take", F.explode(takes)).where("_take > 0")
    text = F.when(F.col("_take") >= F.col("_size"), F.col("text")).otherwise(first_words(F.col("text"), F.col("_take")))
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
