"""Joining documents on the Jaccard similarity of their word n-grams, with adaptive multi-match prefixes.

All n-grams get one order: those of rare words first, so that few documents meet in what comes first. Two sets over the threshold have
so many common n-grams that the first l of them lie in both prefixes of length
size - least overlap + l, for any l. A document whose prefix would meet many others, by the counts of its
words, gets a larger l: a longer prefix, of which more has to be shared. What is left of a document's
prefix when n-grams that nobody shares are taken away decides whether it can have a partner at all.

The others are verified in stars: in each round a document is compared with the head of its n-grams with which it shares most, if these are as
many as the multi-match rule asks for. Families are the components of the links so found; a family of m documents costs m
comparisons a round and not m x m. Documents that a star brought together but that are not of one family are compared in square blocks of
bounded size, across families only. Those that no star brought together and that may still be linked share several n-grams that
are open. The rule of prefixes applies to these once more, the least shared ones first, and what holds one of the few that are
left is compared in such blocks too. No pairs are listed anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spoor.llm.components import components
from spoor.llm.hashing import WordHashes, blocks, mix, runs
from spoor.llm.sieve import Sieve, key_of
from spoor.llm.substring import keyed
from spoor.scratch import discard, materialize

#: Words whose counts are known. They set the order of n-grams, which never changes a result.
FREQUENT = 1 << 17
#: Part of its size that every document asks to be shared within the prefixes.
SURE = 24
#: Rounds of stars. What they leave apart is compared all the same, so they never change a result either.
ROUNDS = 2
#: Documents of a block's side.
SIDE = 512
SIDE_BYTES = 4 << 20


class Known:
    """Counts of the most frequent words, by hash; 0 for any other."""

    def __init__(self, word: np.ndarray, count: np.ndarray):
        by = np.argsort(word)
        self.word, self.count = word[by], count[by]

    def counts(self, word: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[at] == word, self.count[at], 0)


def gram_sets(texts: list[str], n: int, hashes: WordHashes, known: Known) -> list[tuple[np.ndarray, np.ndarray]]:
    """The different n-gram hashes of each text, in the order of all: by the count of the n-gram's rarest
    word, then by hash; and those counts. A-Z count as a-z; a text of fewer words is one n-gram of all its words."""
    split = [t.encode().lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in split])
    h = hashes.of([w for words in split for w in words])
    word, of = np.unique(h, return_inverse=True)
    count = known.counts(word)[of]
    every = runs(h, n) if len(h) >= n else h[:0]
    rarest = count[: len(every)].copy()
    for k in range(1, n):
        np.minimum(rarest, count[k : k + len(every)], out=rarest)
    out = []
    for words, end in zip(split, ends, strict=True):
        start, k = end - len(words), len(words)
        if k >= n:
            grams, first = np.unique(every[start : end - n + 1], return_index=True)
            met = rarest[start : end - n + 1][first]
            order = np.argsort(met, kind="stable")
            out.append((grams[order], met[order]))
        else:
            out.append((runs(h[start:end], k) if k else h[:0], np.zeros(min(k, 1), np.int64)))
    return out


def least_overlap(size: np.ndarray | int, percent: int):
    """The overlap that any set similar to one of this size has with it."""
    return (percent * size + 99) // 100


def sure_matches(size: Column, percent: int) -> Column:
    """What even the smallest partner of a set of this size asks for."""
    least = F.floor((size * percent + 99) / 100).cast("int")
    return F.least(least, 1 + F.floor(least / SURE).cast("int"))


def wanted_matches(met: np.ndarray, percent: int) -> int:
    """l of a document, from the counts of its n-grams in order. Every document asks for 1 / SURE of its size, so that it
    is known of its partners without seeing them; the rest grows with the logarithm of the estimated cost, which is how
    often the words of its shortest prefix occur."""
    size = len(met)
    least = least_overlap(size, percent)
    cost = met[: size - least + 1].mean()
    return min(least, 1 + size // SURE + int(size * np.log2(1 + cost) / 128))


def frequent_words(docs: DataFrame, size: int = FREQUENT) -> Known:
    """Counts over all texts of at most ``size`` most frequent words, a bounded table. Counting is lossy: a count is too
    low by up to one for each stretch of 1.5 million words; this only shifts the order of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        waiting, room = [], 0

        def count() -> pa.RecordBatch:
            word, times = np.unique(np.concatenate(waiting), return_counts=True)
            many = times > 1
            return pa.RecordBatch.from_arrays([pa.array(word[many].view(np.int64)), pa.array(times[many])], ["word", "n"])

        for _, texts in blocks(batches, 0):
            waiting.append(hashes.of([w for t in texts for w in t.encode().lower().split()]))
            room += len(waiting[-1])
            if room > 1_500_000:
                yield count()
                waiting, room = [], 0
        if waiting:
            yield count()

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "jaccard-words")
    # Steps of a fifth: a fixed number of them tells the least count whose words fit.
    step = F.floor(F.log2("n") * 4).cast("int")
    least, room = 0, size
    for s, words in sorted(((r["s"], r["count"]) for r in counted.groupBy(step.alias("s")).count().collect()), reverse=True):
        if words > room:
            least = s + 1
            break
        room -= words
    rows = counted.where(step >= least).toArrow()
    discard(docs.sparkSession, counted.scratch_path)
    return Known(rows["word"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64))


def profiles(docs: DataFrame, n: int, percent: int, known: Known) -> DataFrame:
    """``doc_id, tie, size, node, twin, matches, prefix``: the size of each set, two hashes of its
    content (null without words), the matches it asks for, and its prefix for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part, texts in blocks(batches, 2):
            sizes, nodes, twins, matches, prefixes = [], [], [], [], []
            for grams, met in gram_sets(texts, n, hashes, known):
                s = len(grams)
                sizes.append(s)
                if s:
                    nodes.append(mix(np.array([grams.sum()], np.uint64), s, 0).view(np.int64)[0])
                    twins.append(mix(np.array([mix(grams, s, 1).sum()], np.uint64), s, 1).view(np.int64)[0])
                    matches.append(wanted_matches(met, percent))
                    prefixes.append(grams[: s - least_overlap(s, percent) + matches[-1]].view(np.int64))
                else:
                    nodes.append(None)
                    twins.append(None)
                    matches.append(0)
                    prefixes.append([])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(twins, pa.int64()), pa.array(matches, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "tie", "size", "node", "twin", "matches", "prefix"],
            )

    return docs.select("doc_id", "tie", "text").mapInArrow(run, "doc_id long, tie long, size long, node long, twin long, matches int, prefix array<long>")


def forest(sizes: np.ndarray, sides: np.ndarray, families: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between families in a block: between side 0 and side 1, or, if all are of side 0, among
    all."""
    k = len(sets)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[gram] > 1
    gram, row = np.unique(gram[several], return_inverse=True)[1], np.repeat(np.arange(k), sizes)[several]
    common = np.zeros((k, k), np.float32)
    for at in range(0, int(gram.max(initial=-1)) + 1, 4096):
        here = (gram >= at) & (gram < at + 4096)
        m = np.zeros((k, 4096), np.float32)
        m[row[here], gram[here] - at] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    linked = np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1)
    linked &= families[:, None] != families[None, :]
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    parent = list(range(k))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(linked), strict=True):
        ra, rb = root(int(a)), root(int(b))
        if ra != rb:
            parent[rb] = ra
            out.append((int(a), int(b)))
    return out


def different_sets(profile: DataFrame) -> DataFrame:
    """``node, twin, id, doc_id, tie, size, first``: one row per different set, with the document that stands for it.
    A set is known by both hashes; id is the first, or a hash of both for a set that shares its first hash."""
    sets = profile.where("node is not null").groupBy("node", "twin").agg(F.min(F.struct("doc_id", "tie")).alias("rep"), F.first("size").alias("size"), F.min("doc_id").alias("first"))
    least = sets.groupBy("node").agg(F.min("twin").alias("least"))
    number = F.when(F.col("twin") == F.col("least"), F.col("node")).otherwise(F.xxhash64("node", "twin"))
    return sets.join(least, "node").select("node", "twin", number.alias("id"), "rep.doc_id", "rep.tie", "size", "first")


def without(rows: DataFrame, gone: DataFrame, doc_id: Column, tie: Column) -> DataFrame:
    """``rows`` without those that ``gone`` (doc_id, tie, key) names. Only rows that may be among them are shuffled."""
    named = rows.columns
    rows = rows.withColumn("_gone_id", doc_id).withColumn("_gone_tie", tie)
    rows = rows.withColumn("_gone_key", F.xxhash64("_gone_id", "_gone_tie")).withColumn("_gone_maybe", Sieve(gone, "key").may_hold("_gone_key"))
    g = gone.select(F.col("doc_id").alias("_gone_by_id"), F.col("tie").alias("_gone_by_tie"))
    maybe = rows.where("_gone_maybe").join(g.hint("shuffle_hash"), F.col("_gone_id").eqNullSafe(F.col("_gone_by_id")) & (F.col("_gone_tie") == F.col("_gone_by_tie")), "left_anti")
    return rows.where("not _gone_maybe").unionByName(maybe).select(*named)


def met_prefixes(profile: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, size, matches, center, grams`` of the sets that can have a partner: ``grams`` is what others share of the
    prefix, center how many share it, on average.

    Of any l n-grams that two linked sets share first, the last lies in the first size - least overlap + l;
    so the l-th shared n-gram of a prefix must lie there, for every l that even the smallest partner asks for.
    """
    spark = profile.sparkSession
    copies = profile.where("node is not null").select("doc_id", "tie", "node", "twin").join(sets.select("node", "twin", F.struct("doc_id", "tie").alias("rep")), ["node", "twin"])
    copies = materialize(copies.where(~F.struct("doc_id", "tie").eqNullSafe(F.col("rep"))).select("doc_id", "tie", F.xxhash64("doc_id", "tie").alias("key")).distinct(), "jaccard-copies")
    # Rows alike in id and text are one set's, so they stay together and count once below.
    own = F.when(F.col("twin") == F.col("least"), F.col("node")).otherwise(F.xxhash64("node", "twin"))
    clash = materialize(sets.where("id != node").select("node").distinct(), "jaccard-clashes")
    reps = without(profile.where("node is not null"), copies, F.col("doc_id"), F.col("tie"))
    if not clash.isEmpty():
        least = sets.join(clash, "node", "left_semi").groupBy("node").agg(F.min("twin").alias("least"))
        reps = reps.join(least, "node", "left").withColumn("node", F.when(F.col("least").isNull(), F.col("node")).otherwise(own))
    repeated = profile.where("node is not null").groupBy("doc_id", "tie").count().where("count > 1")
    if not repeated.isEmpty():
        reps = reps.groupBy("node").agg(F.first("size").alias("size"), F.first("matches").alias("matches"), F.first("prefix").alias("prefix"))
    # Written once: two filters in one stage would keep twice as many Python workers in memory.
    reps = materialize(reps.select("node", "size", "matches", "prefix"), "jaccard-prefixes")

    rows = reps.select("node", F.col("size").cast("int").alias("size"), "matches", F.posexplode("prefix").alias("pos", "gram"))
    shared = materialize(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jaccard-shared")
    rows = Sieve(shared, "gram").keep(rows, "gram").join(shared, "gram")  # most n-grams occur once and stay behind
    met = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("matches").alias("matches"), F.sort_array(F.collect_list(F.struct("pos", "gram", "df"))).alias("met"))
    least, sure = F.floor((F.col("size") * percent + 99) / 100).cast("int"), sure_matches(F.col("size"), percent)
    in_place = F.forall(F.transform(F.slice("met", F.lit(1), sure), lambda m, i: m["pos"] <= F.col("size") - least + i), lambda ok: ok)
    met = met.where((F.size("met") >= sure) & in_place)
    center = F.aggregate("met", F.lit(0.0), lambda a, m: a + m["df"], lambda a: a / F.size("met"))
    out = materialize(met.select("node", "size", "matches", center.alias("center"), F.col("met.gram").alias("grams")), "jaccard-met")
    for table in (copies, clash, reps, shared):
        discard(spark, table.scratch_path)
    return out


def families(docs: DataFrame, sets: DataFrame, met: DataFrame, n: int, percent: int, known: Known) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` found by stars, and ``head, kind, node, family`` of the groups in which members of different families are still to
    be compared.

    In each round every n-gram has a head, and a document belongs to the circles of the heads with which it shares as many n-grams as the
    smaller of the two numbers of matches they ask for. It is compared with the one with which it shares most. Families are the components of
    links: a circle that is one family is done, at the cost of two sets sent for each member. Of the others (kind 0) the families are
    compared with each other. Two linked sets of different circles share at least ``sure_matches`` open n-grams, so of each set's, the least
    shared first, all but the last sure - 1 are enough to bring them together (kind 1).
    """
    spark = met.sparkSession
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    rows = materialize(met.select("node", "size", "matches", "center", F.explode("grams").alias("gram"), F.col("node").alias("circle")), "jaccard-rows")
    tied = edges = None
    for k in range(ROUNDS):
        # The set that shares most heads an n-gram first; later rounds draw another.
        rank = F.struct(-F.col("center"), "node") if k == 0 else F.struct(F.xxhash64("node", F.lit(k)), "node")
        heads = rows.groupBy("gram").agg(F.min(F.struct(rank.alias("rank"), F.struct("node", "size", "matches", "circle").alias("h"))).alias("m")).select("gram", "m.h")
        stars = rows.join(heads, "gram").where((F.col("circle") != F.col("h.circle")) & fits(F.col("size"), F.col("h.size")))
        stars = stars.groupBy(F.col("node").alias("a"), F.col("h.node").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first(F.least("matches", "h.matches")).alias("need")).where("n >= need")
        stars = materialize(stars.select("a", "b", "n"), "jaccard-stars")
        new = verified(docs, stars.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")), sets, n, percent, known)
        edges = new if edges is None else edges.unionByName(new)
        tied = stars.select("a", "b") if tied is None else tied.unionByName(stars.select("a", "b"))
        circles = components(tied).select("node", F.col("label").alias("circle"))
        named = rows.drop("circle").join(circles, "node", "left").withColumn("circle", F.coalesce("circle", "node"))
        named = materialize(named, "jaccard-rows")
        discard(spark, rows.scratch_path)
        # Only n-grams that several circles share are left.
        open_grams = named.groupBy("gram").agg(F.min("circle").alias("x"), F.max("circle").alias("y")).where("x != y").select("gram")
        rows = materialize(named.join(open_grams, "gram", "left_semi"), "jaccard-rows")
        discard(spark, named.scratch_path)
    found = components(edges).select("node", F.col("label").alias("family"))
    inside = circles.join(found, "node", "left").select(F.col("circle").alias("head"), F.lit(0).alias("kind"), "node", F.coalesce("family", "node").alias("family"))
    mixed = inside.groupBy("head").agg(F.min("family").alias("x"), F.max("family").alias("y")).where("x != y").select("head")
    inside = inside.join(mixed, "head")

    held = rows.join(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
    sure = sure_matches(F.col("size"), percent)
    held = held.groupBy("node", "circle").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("held")).where(F.size("held") >= sure)
    few = materialize(held.select("node", "circle", F.explode(F.slice("held", F.lit(1), F.size("held") - sure + 1)).alias("g")).select("node", "circle", "g.gram"), "jaccard-open")
    # N-grams with the same holders are one group.
    groups = few.groupBy("gram").agg(F.min("circle").alias("x"), F.max("circle").alias("y"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("x != y")
    heads = groups.groupBy("n", "who").agg(F.min("gram").alias("gram")).select("gram")
    apart = few.join(heads, "gram").select(F.col("gram").alias("head"), F.lit(1).alias("kind"), "node", F.col("circle").alias("family"))
    groups = materialize(inside.unionByName(apart), "jaccard-groups")
    for table in (rows, few):
        discard(spark, table.scratch_path)
    return edges, groups


def verified(docs: DataFrame, stars: DataFrame, sets: DataFrame, n: int, percent: int, known: Known) -> DataFrame:
    """Those of ``stars`` (a, b) that are links. Each a's set is sent once, each b's once for every ``SIDE`` of its a."""
    split = stars.join(stars.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("parts")), "b")
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    place = lambda i, second: F.struct(F.col("b").alias("head"), F.lit(2).alias("kind"), i.alias("i"), F.lit(0).alias("j"), F.lit(second).alias("second"), F.lit(0).cast("long").alias("family"))
    members = split.select(F.col("a").alias("node"), place(part, 1).alias("place"))
    heads = split.groupBy("b").agg(F.first("parts").alias("parts")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("b").alias("node"), place(F.col("i"), 0).alias("place"))
    needed = members.unionByName(heads).groupBy("node").agg(F.collect_list("place").alias("places"))
    placed = _placed_sets(docs, needed, sets, n, known).repartition("head", "i").sortWithinPartitions("head", "i", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            head, i, second, node = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("head", "i", "second", "node"))
            grams = batch.column(batch.schema.get_field_index("grams"))
            a, b = [], []
            for k in range(batch.num_rows):
                mine = np.frombuffer(grams[k].as_buffer(), np.uint64)
                if not second[k]:
                    at, own = (head[k], i[k]), np.sort(mine)
                    continue
                assert at == (head[k], i[k])  # its head comes first
                place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                common = int((own[place] == mine).sum())
                if 100 * common >= percent * (len(own) + len(mine) - common):
                    a.append(node[k])
                    b.append(head[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialize(placed.mapInArrow(run, "a long, b long"), "jaccard-links")


def links(docs: DataFrame, profile: DataFrame, sets: DataFrame, n: int, percent: int, known: Known) -> DataFrame:
    """Edges ``a, b`` between ids of sets: all of them are links, and every link's ends are connected."""
    spark = docs.sparkSession
    met = met_prefixes(profile, sets, percent)
    edges, groups = families(docs, sets, met, n, percent, known)

    # The largest family of a group is dealt to sides of its own, which never meet each other: a few strangers meet a large family once.
    group = ["head", "kind"]
    sized = groups.join(sets.select(F.col("id").alias("node"), "size"), "node")
    of_family = sized.groupBy(*group, "family").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("grams"))
    parts = lambda m, grams: F.greatest(F.ceil(m / SIDE), F.ceil(grams * 8 / SIDE_BYTES)).cast("int")
    totals = of_family.groupBy(*group).agg(F.sum("m").alias("m"), F.sum("grams").alias("grams"), F.max(F.struct("m", "grams", "family")).alias("most"))
    own_sides, others = parts(F.col("most.m"), F.col("most.grams")), parts(F.col("m") - F.col("most.m"), F.col("grams") - F.col("most.grams"))
    # What fits one block is one.
    small = parts(F.col("m"), F.col("grams")) <= 1
    totals = totals.select(*group, F.when(~small, F.col("most.family")).alias("largest"), F.when(small, 0).otherwise(own_sides).alias("own_sides"), F.when(small, 1).otherwise(others).alias("others"))
    sized = sized.join(totals, group)
    own = F.coalesce(F.col("family") == F.col("largest"), F.lit(False))
    side = F.when(own, F.col("others") + F.pmod(F.xxhash64("node"), F.col("own_sides"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    sized = sized.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("others")).otherwise(F.col("others") + F.col("own_sides")) - 1)))
    place = F.struct("head", "kind", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), (F.col("side") > F.col("other")).cast("int").alias("second"), "family")
    placed = _placed_sets(docs, sized.groupBy("node").agg(F.collect_list(place).alias("places")), sets, n, known)

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        grams = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        second = rows["second"].to_numpy() if rows["i"].iloc[0] != rows["j"].iloc[0] else np.zeros(len(rows), np.int64)
        found = forest(rows["size"].to_numpy(np.int64), second, rows["family"].to_numpy(np.int64), grams, percent)
        return pd.DataFrame([(node[a], node[b]) for a, b in found], columns=["a", "b"], dtype=np.int64)

    rest = placed.groupBy("head", "kind", "i", "j").applyInPandas(block, "a long, b long")
    out = materialize(edges.unionByName(rest), "jaccard-links")
    for table in (met, groups):
        discard(spark, table.scratch_path)
    return out


def _placed_sets(docs: DataFrame, needed: DataFrame, sets: DataFrame, n: int, known: Known) -> DataFrame:
    """Whole sets of the ``needed`` (node, places), a row for each place: ``head, kind, i, j, second, family, node, size, grams``. The text is that of the
    document that stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = WordHashes(), set()
        for part, texts in blocks(batches, 2):
            rows, room = [], 0
            for node, places, (grams, _) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), gram_sets(texts, n, hashes, known), strict=True):
                if node in met:  # a row that repeats
                    continue
                met.add(node)
                whole = grams.tobytes()
                for p in places:
                    rows.append((p["head"], p["kind"], p["i"], p["j"], p["second"], p["family"], node, len(grams), whole))
                    room += len(whole)
                    if room >= SIDE_BYTES:
                        yield _batch(rows)
                        rows, room = [], 0
            if rows:
                yield _batch(rows)

    spark = docs.sparkSession
    needed = materialize(needed.join(sets.select(F.col("id").alias("node"), "doc_id", "tie"), "node"), "jaccard-needed")
    w = needed.select(F.col("doc_id").alias("w_doc_id"), F.col("tie").alias("w_tie"), "node", "places")
    docs = Sieve(needed.select(key_of().alias("k")), "k").keep(docs.withColumn("k", key_of()), "k")
    rows = docs.join(w.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(w["w_doc_id"]) & (docs["tie"] == w["w_tie"]))
    return rows.select("node", "places", "text").mapInArrow(run, "head long, kind int, i int, j int, second int, family long, node long, size long, grams binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["head", "kind", "i", "j", "second", "family", "node", "size", "grams"])


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id`` (and tie, a hash of the text, and label, the component's own).

    n_shingles: different n-grams of the text. Two documents are linked if 100 x intersection is at least
    ``percent`` x union; component_id is the smallest doc_id that links reach, null if all of them are null. A
    document without words, a null text too, is linked with nothing and stands for itself. Documents with
    one set are one node, so copies are never compared. An empty table gives an empty one.
    """
    docs = keyed(docs)
    known = frequent_words(docs)
    profile = materialize(profiles(docs, n, percent, known), "jaccard-profiles")
    sets = materialize(different_sets(profile), "jaccard-sets")
    found = links(docs, profile, sets, n, percent, known)
    labels = components(found)
    nodes = sets.join(labels.withColumnRenamed("node", "id"), "id", "left").select("node", "twin", "first", F.coalesce("label", "id").alias("label"))
    heads = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    nodes = nodes.join(heads, "label").select("node", "twin", "label", "component_id")
    rows = profile.select("doc_id", "tie", F.col("size").alias("n_shingles"), "node", "twin")
    alone = rows.where("node is null").withColumns({"component_id": F.col("doc_id"), "label": F.lit(None).cast("long")})
    out = rows.where("node is not null").join(nodes, ["node", "twin"]).unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", "tie", "label")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each component: that of the smallest doc_id, of several the one with
    the smallest hash of its text. Documents without words all stay. Columns stay as they are."""
    found = materialize(join(docs, n, percent), "jaccard-components")
    whole = found.where("label is not null")
    # A component is summed up, not gathered.
    first = whole.groupBy("label").agg(F.min(F.struct("doc_id", "tie")).alias("k"))
    gone = whole.join(first, "label").where(~F.struct("doc_id", "tie").eqNullSafe(F.col("k"))).select("doc_id", "tie", F.xxhash64("doc_id", "tie").alias("key")).distinct()
    kept = without(docs, materialize(gone, "jaccard-gone"), F.col("doc_id").cast("long"), F.xxhash64("text"))
    if whole.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        return kept
    empty = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")  # rows that repeat, id and text
    return kept.where(empty).unionByName(kept.where(~empty).dropDuplicates(["doc_id", "text"]))
