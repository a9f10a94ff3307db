"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spoor.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b): label is the smallest node that it reaches.

    Rounds of large star (each node hands its larger neighbours to its smallest) and small star
    (the same for the smaller ones) until nothing changes; each round is written to the shared
    folder. A node's neighbours are summed up before they meet, and the joins can be split where a
    node has many.
    """
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        small = materialize(small, "edges")
        # Stars only: every edge points from a node to a smallest one that points nowhere.
        done = small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty()
        edges = small
        if done:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
