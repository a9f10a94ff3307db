"""Document fingerprints: the k smallest shingle hashes of a text (a bottom-k sketch).

Sketches of parts merge into the sketch of the whole. Two of them estimate resemblance and
containment, one estimates the number of different shingles. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoor.llm.common import n_partitions

K = 128
SHINGLE = 5
SPACE = r"[\x20\x09-\x0D]+"


def sketches(df: DataFrame, texts: dict[str, Column], k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with one more column per text: the ascending array of its k smallest hashes of
    ``shingle`` words in a row. A text of fewer words counts as one shingle; one without words, or
    null, has none.

    Each step is a column of its own, so the hashes of the words are worked out once per text.
    """
    keep = df.columns
    df = df.select("*", *[F.transform(F.filter(F.split(F.coalesce(t, F.lit("")), SPACE, -1), lambda w: w != ""), lambda w: F.xxhash64(w)).alias(f"_words_{c}") for c, t in texts.items()])
    hashes = []
    for c in texts:
        word = F.col(f"_words_{c}")
        rolled = F.transform(word, _rolled(word, shingle))
        whole = F.when(F.size(word) == 0, F.slice(word, 1, 0)).otherwise(F.array(F.xxhash64(F.lit(shingle), word)))
        hashes.append(F.when(F.size(word) >= shingle, F.slice(rolled, F.lit(1), F.greatest(F.size(word) - (shingle - 1), F.lit(0)))).otherwise(whole).alias(c))
    df = df.select(*keep, *hashes)
    return df.select(*keep, *[F.slice(F.sort_array(F.array_distinct(c)), 1, k).alias(c) for c in texts])


def _rolled(word: Column, shingle: int):
    return lambda h, i: F.xxhash64(h, *[F.get(word, i + j) for j in range(1, shingle)])


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in all of both: of the k smallest of both, those in each.
    Exact when both texts have at most k. Two without shingles are alike (1); one without is not (0)."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles: the sketch's size if it is not full, else from where
    its largest hash lies in the range of hashes."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an a without shingles."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_parts(parts: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts. Each task passes on k hashes per key at
    most (the rank limit is applied before the shuffle too), so a key of any size is safe."""
    hashes = parts.select(*keys, F.explode(sketch).alias("_h")).groupBy(*keys, "_h").agg(F.lit(1).alias("_one"))
    ranked = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def in_ranges(docs: DataFrame, n: int) -> DataFrame:
    """Columns ``doc_id, text, range, ghost``: rows in about n ranges of (doc_id, hash of the text) of about equal size,
    and the first row of each range once more, as a ghost, in the range before it (the first range's in
    the last). Null ids come first. Rows of one id spread over ranges by their texts; only rows alike in both stay
    together. The bounds are percentiles, n numbers in a table of one row, looked up in two steps of about the square
    root of n comparisons."""
    spark, c = docs.sparkSession, F.col
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # One number in the order of both; where it rounds, neighbours get one place, never a wrong order.
    tie = c("tie").cast("double")
    place = F.when(c("doc_id").isNull(), tie * 2.0**900 - 2.0**1000).otherwise(c("doc_id").cast("double") * 2.0**64 + tie)
    bounds = sorted(set(rows.agg(F.percentile_approx(place, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []))
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    table = spark.createDataFrame([([b[-1] for b in blocks], blocks)], "_last array<double>, _blocks array<array<double>>")
    below = lambda values: F.size(F.filter(values, lambda b: b <= c("_place")))
    ranged = rows.withColumn("_place", place).crossJoin(F.broadcast(table)).withColumn("_block", below(c("_last")))  # one row
    inside = F.get(c("_blocks"), c("_block"))
    ranged = ranged.withColumn("range", c("_block") * step + F.when(inside.isNull(), 0).otherwise(below(inside))).drop("_last", "_blocks", "_block", "_place")
    first = F.min(F.struct(c("doc_id").isNotNull().alias("known"), "doc_id", "tie"))
    firsts = sorted((r["range"], r["doc_id"], r["tie"]) for r in ranged.groupBy("range").agg(first.alias("f")).select("range", "f.doc_id", "f.tie").collect())
    ghosts = spark.createDataFrame([(*f, firsts[k - 1][0]) for k, f in enumerate(firsts)], "_range int, _first long, _tie long, _before int")
    rows = ranged.join(F.broadcast(ghosts), c("range") == c("_range"))  # at most n rows
    own, ghost = (F.struct(r.alias("r"), F.lit(g).alias("g")) for r, g in ((c("range"), False), (c("_before"), True)))
    places = F.when(c("doc_id").eqNullSafe(c("_first")) & (c("tie") == c("_tie")), F.array(own, ghost)).otherwise(F.array(own))
    return rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", c("p.r").alias("range"), c("p.g").alias("ghost"))


def compare_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last quarter is replaced by
    the beginning of the next document by doc_id (after the last: the first).

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_in_edited, n_shingles``. A null text counts as empty. Rows of one id follow each other
    by the hash of their text, null ids come first; rows alike in id and text fall into one range. A lone
    document is its own next. An empty table gives an empty one. The texts are shuffled once, by ranges.
    """
    rows = in_ranges(docs, 4 * n_partitions(docs.sparkSession))
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.withColumn("_next", F.lead("text").over(order))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(char_length(text) - floor(char_length(text) / 4) as int))"), F.coalesce(F.substring("_next", F.lit(1), quarter), F.lit("")))
    rows = rows.select("doc_id", "range", "ghost", "text", n.cast("long").alias("n_chars"), edited.alias("_edited"))
    rows = sketches(rows, {"_own": F.col("text"), "_other": F.col("_edited")}, k)
    rows = rows.withColumn("_following", F.lead("_own").over(order)).where(~F.col("ghost"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_other")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_other"), k).alias("near_edited"),
        resemblance(F.col("_own"), F.col("_following"), k).alias("near_next"),
        containment(F.col("_own"), F.col("_other"), k).alias("contained_in_edited"),
        distinct_shingles(F.col("_own"), k).alias("n_shingles"),
    )
