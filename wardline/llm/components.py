"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b`` long, not null); the label is the least node.

    Large-star and small-star steps alternate until the edges are stars. Each step is one aggregation
    to the least neighbour and one join back on the node, and each round is written to the shared
    folder, so that plans stay short and a lost executor costs one round.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Each node links its larger neighbours to the least node that it knows.
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Each node links its smaller neighbours, and itself, to the least of them.
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = large.join(small_least, "b")
        edges = stage(
            pairs.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(pairs.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1000003), F.sum(F.col("b") % 1000003)).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
