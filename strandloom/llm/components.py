"""Connected components by alternating large and small stars, entirely in DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of `edges` (two long columns, any order, repeats allowed).

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.  Loops and
    edges with a null end are ignored; no edges give no rows.
    """
    left, right = edges.columns
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter("a <> b").distinct()
    pairs = materialise(pairs)
    before = _state(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        pairs = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = _state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
