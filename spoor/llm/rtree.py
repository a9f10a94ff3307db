"""Hard negatives by exact inner-product search in a sort-tile-recursive packed R-tree.

The rows are packed into tiles: sorted by one coordinate into slabs, in each slab by another into tiles, both times by range over
all tasks. A tile's rows are packed the same way into leaves, each of one label, and leaves into the nodes above them. A node's
bounding box gives an interval of the inner product with an anchor, coordinate by coordinate. Anchors are the query set: blocks of them meet the
tiles whose boxes can still matter to one of them. Inside a tile a best-first queue takes the node of the highest bound first and drops those
outside all of the anchor's score windows and those strictly below the worst of the k found so far (or as high, but with larger ids only).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spoor.llm.common import materialize, n_partitions
from spoor.scratch import discard

#: Rows of a tile at most, about; a tile is searched in one task.
TILE = 32_768
#: Rows of a leaf, and nodes below a node.
LEAF, FAN = 128, 16
#: Anchors of a block at most, about.
BLOCK = 4096
SCALE = 256
NO_ID = np.iinfo(np.int64).max
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Whole numbers up to this one are exact in double precision.
EXACT = 2.0**53


def taking_part(rows: DataFrame) -> DataFrame:
    """``vec_id, label, tie, embedding`` of the rows that take part: neither label nor vector null, all components finite. Where vec_id is
    divisible by 7 the label is the next of ten. tie: a hash of label and vector, to tell rows of one id apart."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    vector = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("embedding"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.xxhash64("label", "embedding").alias("tie"), "embedding")


def tiles(rows: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """The rows with ``tile``. Slabs and tiles are cut along the two coordinates that spread most; rows alike there are told apart by
    their ids, so that copies of one vector fill as many tiles as they need."""
    spark = rows.sparkSession
    spread = rows.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    widest = [r["pos"] for r in spread.orderBy(F.col("v").desc_nulls_last(), "pos").limit(2).collect()]
    at = [F.get("embedding", F.lit(c)) for c in (widest + widest[:1] + [0, 0])[:2]]
    n = rows.count()
    tile_rows = tile_rows or max(LEAF, min(TILE, -(-n // n_partitions(spark))))
    count = max(1, -(-n // tile_rows))
    slabs = math.ceil(math.sqrt(count))
    cuts = []
    if slabs > 1:
        cuts = rows.select(F.percentile_approx(at[0].cast("double"), [k / slabs for k in range(1, slabs)], max(10_000, 10 * slabs)).alias("c")).first()["c"] or []
    slab = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.coalesce(at[0].cast("double"), F.lit(0.0)))) if cuts else F.lit(0)
    placed = rows.withColumn("slab", slab).repartitionByRange(count, F.col("slab"), at[1], F.col("vec_id"), F.col("tie"))
    return placed.withColumn("tile", F.spark_partition_id()).drop("slab")


def quantised(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of whole numbers in double precision; shorter ones are filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64) if not isinstance(column, pa.ChunkedArray) else ids_of(column.combine_chunks())


class Tree:
    """A packed R-tree of the rows of one tile. Rows that repeat count once."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        seen = np.unique(np.stack([ids, ties], 1), axis=0, return_index=True)[1] if len(ids) else np.zeros(0, np.int64)
        ids, ties, labels, vectors = ids[seen], ties[seen], labels[seen], vectors[seen]
        spread = np.argsort(-vectors.var(0), kind="stable")[:2] if vectors.shape[1] and len(vectors) else []
        leaves: list[np.ndarray] = []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            leaves += self._packed(own, vectors, ids, spread)
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.ids, self.ties, self.labels, self.vectors = ids[order], ties[order], labels[order], vectors[order]
        starts = np.cumsum([0, *map(len, leaves)])
        self.leaf = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        # Nodes: leaves first, then each level above; children of node k are below[k].
        low = [self.vectors[a:b].min(0) for a, b in self.leaf]
        high = [self.vectors[a:b].max(0) for a, b in self.leaf]
        first = [int(self.ids[a:b].min()) for a, b in self.leaf]
        one_label: list[int | None] = [int(self.labels[a]) for a, _ in self.leaf]
        self.below: list[list[int]] = [[] for _ in self.leaf]
        level = list(range(len(self.leaf)))
        while len(level) > 1:
            above = []
            for k in range(0, len(level), FAN):
                part = level[k : k + FAN]
                above.append(len(low))
                low.append(np.min([low[c] for c in part], axis=0))
                high.append(np.max([high[c] for c in part], axis=0))
                first.append(min(first[c] for c in part))
                labels_below = {one_label[c] for c in part}
                one_label.append(labels_below.pop() if len(labels_below) == 1 else None)
                self.below.append(part)
            level = above
        self.root = level[0] if level else None
        self.low, self.high, self.first, self.label = np.array(low), np.array(high), first, one_label

    @staticmethod
    def _packed(own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, spread) -> list[np.ndarray]:
        """Sort-tile-recursive packing of some rows into leaves."""
        leaves = -(-len(own) // LEAF)
        slabs = math.ceil(math.sqrt(leaves))
        per_slab = LEAF * -(-leaves // slabs)
        key = [vectors[own, c] for c in spread]
        own = own[np.lexsort((ids[own], key[0]))] if key else own[np.argsort(ids[own])]
        out = []
        for a in range(0, len(own), per_slab):
            slab = own[a : a + per_slab]
            if len(key) > 1:
                slab = slab[np.lexsort((ids[slab], vectors[slab, spread[1]]))]
            out += [slab[b : b + LEAF] for b in range(0, len(slab), LEAF)]
        return out

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with what a node's box can hold."""
        plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T


class Best:
    """The k best (score, id, tie) of one window, worst last; ``worst`` is what a row has to beat once they are k."""

    def __init__(self, low: float, high: float, k: int, worst: tuple | None):
        self.low, self.high, self.k, self.found, self.worst = low, high, k, [], worst

    def wants(self, least: float, most: float, first: int) -> bool:
        """Whether a node with scores between these and ids from ``first`` on may hold a better row."""
        if most < self.low or least > self.high:
            return False
        return self.worst is None or most > self.worst[0] or most == self.worst[0] and first <= self.worst[1]

    def add(self, score, row_id: int, tie: int) -> None:
        if not self.low <= score <= self.high:
            return
        entry = (-score, row_id, tie)
        if self.worst is not None and (score < self.worst[0] or score == self.worst[0] and row_id > self.worst[1]):
            return
        self.found.append(entry)
        self.found.sort()
        del self.found[self.k :]
        if len(self.found) == self.k:
            score, row_id, _ = self.found[-1]
            self.worst = (-score, row_id)


def whole_scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, those beyond 64 bits cut to the largest or smallest."""
    own = [int(y) for y in anchor]
    return np.array([min(max(sum(int(x) * y for x, y in zip(row, own, strict=True)), LEAST), MOST) for row in vectors], object)


def search(tree: Tree, anchor: np.ndarray, anchor_id: int, anchor_tie: int, label: int, same: bool, windows: list[Best], least: np.ndarray, most: np.ndarray, exact: bool) -> None:
    """Best-first search of one anchor among the rows of its own label (``same``) or of the others."""
    if tree.root is None:
        return
    wrong = (lambda x: x is not None and x != label) if same else (lambda x: x == label)
    queue = [(-most[tree.root], tree.root)]
    while queue:
        bound, node = heapq.heappop(queue)
        if exact and not any(w.wants(least[node], -bound, tree.first[node]) for w in windows):
            if all(-bound < w.low or w.worst is not None and -bound < w.worst[0] for w in windows):
                return  # no later entry has a higher bound
            continue
        if tree.below[node]:
            for child in tree.below[node]:
                if not wrong(tree.label[child]):
                    heapq.heappush(queue, (-most[child], child))
            continue
        if wrong(tree.label[node]):
            continue
        a, b = tree.leaf[node]
        scores = tree.vectors[a:b] @ anchor if exact else whole_scores(tree.vectors[a:b], anchor)
        for w in windows:
            fits = (scores >= w.low) & (scores <= w.high)
            if w.worst is not None:
                fits &= scores >= w.worst[0]
            place = np.flatnonzero(fits.astype(bool))
            if len(place) > w.k:  # the best of the leaf only, in order
                place = place[np.lexsort((tree.ties[a:b][place], tree.ids[a:b][place], -scores[place].astype(np.float64)))] if exact else np.array(sorted(place, key=lambda p: (-scores[p], tree.ids[a + p])))
            for p in place.tolist():
                row_id, tie = int(tree.ids[a + p]), int(tree.ties[a + p])
                if row_id == anchor_id and tie == anchor_tie:
                    continue
                if w.worst is not None and scores[p] < w.worst[0]:
                    continue
                w.add(scores[p], row_id, tie)


FOUND = "anchor_id long, anchor_tie long, win int, score long, row_id long, row_tie long"


def _pad(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors if vectors.shape[1] >= width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def searched(rows: DataFrame, anchors: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """Rows as in ``FOUND``: for each anchor, of each tile that ``pairs`` (block, tile) gives its block, and for each of its windows the k
    best rows.

    anchors: ``block, anchor_id, anchor_tie, label, embedding`` and, for each window, ``low, high`` (lowest and highest score) and
    ``score, id`` that a row has to reach (null: none).
    """

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        vectors, queries = quantised(own["embedding"]), quantised(others["embedding"])
        width = max(vectors.shape[1], queries.shape[1])
        vectors, queries = _pad(vectors, width), _pad(queries, width)
        tree = Tree(ids_of(own["vec_id"]), ids_of(own["tie"]), own["label"].to_numpy(), vectors)
        # Beyond exact doubles the scores are worked out in whole numbers, and no box is trusted.
        exact = bool(np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(1, width) < EXACT)
        least, most = tree.bounds(queries) if exact and tree.root is not None else (np.zeros((len(queries), max(1, len(tree.below)))),) * 2
        out: list[tuple] = []
        columns = [others[c].to_pylist() for c in ("anchor_id", "anchor_tie", "label", "low", "high", "score", "id")]
        for n, (anchor_id, tie, label, low, high, score, row_id) in enumerate(zip(*columns, strict=True)):
            windows = [Best(a, b, k, None if s is None else (s, NO_ID if i is None else i)) for a, b, s, i in zip(low, high, score, row_id, strict=True)]
            search(tree, queries[n], anchor_id, tie, label, same, windows, least[n], most[n], exact)
            for j, w in enumerate(windows):
                out += [(anchor_id, tie, j, int(-s), None if i == NO_ID else i, t) for s, i, t in w.found]
        cols = list(zip(*out, strict=True)) or [()] * 6
        names = ["anchor_id", "anchor_tie", "win", "score", "row_id", "row_tie"]
        return pa.table([pa.array(c, pa.int32() if n == "win" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)

    left = rows.join(pairs, "tile").groupBy("tile", "block")
    right = anchors.join(pairs, "block").groupBy("tile", "block")
    return left.cogroup(right).applyInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and window with their ``rank``."""
    order = Window.partitionBy("anchor_id", "anchor_tie", "win").orderBy(F.col("score").desc(), F.col("row_id").asc_nulls_last(), "row_tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def boxes(rows: DataFrame, by: str) -> DataFrame:
    """``by, low, high``: the bounding box of each group's quantised vectors."""

    def run(part: pa.Table) -> pa.Table:
        vectors = quantised(part["embedding"])
        return pa.table([part[by].slice(0, 1), pa.array([vectors.min(0)]), pa.array([vectors.max(0)])], names=[by, "low", "high"])

    return rows.select(by, "embedding").groupBy(by).applyInArrow(run, f"{by} int, low array<double>, high array<double>")


def alive(anchors: DataFrame, tile_boxes: DataFrame) -> DataFrame:
    """``block, tile``: the tiles whose box may hold a row that an anchor of the block still wants. Boxes are compared with boxes: a row per
    block and a row per tile, with no row of the table itself."""
    need = F.array_min(F.transform(F.arrays_zip("low", "score"), lambda w: F.greatest(w["low"], w["score"]))).cast("double")
    wants = anchors.groupBy("block").agg(F.min(need).alias("need"), F.max(F.array_max("high")).cast("double").alias("most_wanted"))
    blocks = boxes(anchors, "block").join(wants, "block").select("block", F.col("low").alias("bl"), F.col("high").alias("bh"), "need", "most_wanted")
    both = blocks.crossJoin(tile_boxes.select("tile", F.col("low").alias("tl"), F.col("high").alias("th")))
    of = lambda x, c: F.coalesce(x[c], F.lit(0.0))  # noqa: E731  a shorter vector goes on with 0
    corners = lambda x: [of(x, a) * of(x, b) for a in ("bl", "bh") for b in ("tl", "th")]
    zipped = F.arrays_zip("bl", "bh", "tl", "th")
    held = lambda x: F.greatest(F.least(x, F.lit(float(MOST))), F.lit(float(LEAST)))  # noqa: E731  as scores are
    most = held(F.aggregate(zipped, F.lit(0.0), lambda a, x: a + F.greatest(*corners(x))))
    least = held(F.aggregate(zipped, F.lit(0.0), lambda a, x: a + F.least(*corners(x))))
    slack = F.lit(1.0) + F.greatest(F.abs(most), F.abs(least)) * 1e-9
    return both.where((most + slack >= F.col("need")) & (least - slack <= F.col("most_wanted"))).select("block", "tile")


def in_windows(rows: DataFrame, tile_boxes: DataFrame, anchors: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """The k best rows for each window of each anchor (``block, home, anchor_id, anchor_tie, label, embedding, low, high``) over all tiles. Its own
    tile comes first; what is found there tells which other tiles can still matter."""
    spark = rows.sparkSession
    key = ["anchor_id", "anchor_tie"]
    none = F.transform("low", lambda x: F.lit(None).cast("long"))
    at_home = anchors.withColumn("block", F.col("home")).withColumns({"score": none, "id": none})
    home = anchors.select(F.col("home").alias("block"), F.col("home").alias("tile")).distinct()
    found = materialize(best(searched(rows, at_home, home, same, k), k), f"rtree-{name}-home")
    last = found.where(F.col("rank") == k).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("win", F.struct("score", "row_id").alias("w")))).alias("last"))
    reach = lambda c: F.transform("low", lambda x, j: F.col("last")[j.cast("int")][c])
    going_on = materialize(anchors.join(last, key, "left").withColumns({"score": reach("score"), "id": reach("row_id")}).drop("last"), f"rtree-{name}-anchors")
    pairs = materialize(alive(going_on, tile_boxes), f"rtree-{name}-pairs")
    out = materialize(best(searched(rows, going_on, pairs, same, k), k), f"rtree-{name}")
    for table in (found, going_on, pairs):
        discard(spark, table.scratch_path)
    return out


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, tile_rows: int | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (vec_id divisible by ``every``) and each
    of its ``positives`` best other rows of its label the k best rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's.

    A score is the inner product of the vectors, each component taken ``SCALE`` times and rounded down; equal scores are ordered by vec_id. Rows with
    a null label, a null vector or any null or non-finite component take no part. Where vec_id is divisible by 7, the label is the next of ten.

    Shorter vectors count as filled up with 0. A null vec_id is never an anchor and comes last among equals. Rows of one id with other label or
    vector are rows of their own (an anchor each); rows that repeat count once. Scores beyond 64 bits count as the largest or
    smallest such number. Pairs without a negative give no row. Other columns are left out. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    rows = materialize(tiles(taking_part(rows), tile_rows), "rtree-rows")
    tile_boxes = materialize(boxes(rows, "tile"), "rtree-boxes")
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "tie"])
    anchors = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("tie").alias("anchor_tie"), "label", "embedding", F.col("tile").alias("home"))
    # Anchors of neighbouring tiles are one block; a crowd of them is dealt to several.
    sizes = anchors.groupBy("home").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = sizes.select("home", before.alias("begin"))
    place = F.col("begin") + F.row_number().over(Window.partitionBy("home").orderBy("anchor_id", "anchor_tie")) - 1
    anchors = anchors.join(begin, "home").withColumn("block", F.floor(place / BLOCK).cast("int")).drop("begin")
    anchors = materialize(anchors, "rtree-anchors")

    own = anchors.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    near = in_windows(rows, tile_boxes, own, True, positives, "positives")
    percent = lambda p: F.col("score").cast("decimal(19,0)") * p / 100
    of = near.select("anchor_id", "anchor_tie", F.struct("rank", F.ceil(percent(low)).cast("long").alias("low"), F.floor(percent(high)).cast("long").alias("high"), "score", "row_id").alias("p"))
    of = of.groupBy("anchor_id", "anchor_tie").agg(F.sort_array(F.collect_list("p")).alias("p"))
    asked = anchors.join(of, ["anchor_id", "anchor_tie"]).select("*", F.col("p.low").alias("low"), F.col("p.high").alias("high"))
    asked = materialize(asked, "rtree-asked")
    found = in_windows(rows, tile_boxes, asked.drop("p"), False, k, "negatives")
    p = asked.select("anchor_id", "anchor_tie", F.posexplode("p").alias("win", "p"))
    out = found.join(p, ["anchor_id", "anchor_tie", "win"])
    return out.select("anchor_id", F.col("p.row_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
