"""Connected components of an undirected graph given as pairs, as joins and aggregations.

Large-star and small-star steps alternate until no pair changes (Kiveris et
al., "Connected Components in MapReduce and Beyond"). Each step takes minima
per node with map-side aggregation and joins them back, so a node with very
many neighbours is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another.

    ``edges`` has two long columns; loops, repeats and nulls are dropped.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    # a is the larger end throughout
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour of n is tied to the least around n
        large = pairs.join(least, pairs.b == least.n).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, large.a == low.n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("p"))
        pairs = materialize(small.select("p.a", "p.b").where("a <> b").distinct(), "links")
        before, mark = mark, _mark(pairs)
        if before == mark:
            break
    stars = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
