"""Subtree totals of a forest by parallel tree contraction, in join rounds.

Each phase compresses all chains of nodes with one child (pointer doubling: after k rounds a node has looked 2**k nodes
ahead and added up what lies between), puts an edge in the place of each chain, and rakes all leaves into their
parents.  What stays after a phase has at least two children each, so less than half of the nodes do.  The contracted
nodes are then put back, last phase first: a leaf's total is what it had gathered, a chain node's is its sum up to the
chain's end plus the end's total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _plus(frames: tuple[str, ...], weights: list[str]) -> list[Column]:
    return [reduce(lambda a, b: a + b, [F.col(f"{f}{w}") for f in frames]).alias(f"a_{w}") for w in weights]


def _compress(unary: DataFrame, weights: list[str], nodes: int) -> DataFrame:
    """id, end, hops and sums a_ of each node of a chain, and its parent and u_ (what stands on the edge above it).

    `unary` has id, parent, only (its one child), a_, u_ and o_ (on the edge to the child).  No join key is shared: a node has
    one node 2**k before it.  No chain is longer than all `nodes`, so one that still goes on then is a circle.
    """
    first = unary.select("id", "parent", F.col("only").alias("end"), F.lit(1).cast("long").alias("hops"), *_plus(("a_", "o_"), weights), *[f"u_{w}" for w in weights])
    inside = first.select(F.col("id").alias("end"), F.lit(True).alias("more"))
    open_rows = materialise(first.join(inside, "end", "left"))
    closed = [open_rows.filter("more is null").drop("more")]
    open_rows = open_rows.filter("more").drop("more")
    for _ in range(nodes.bit_length() + 1):
        ahead = reduce(DataFrame.unionByName, [c.withColumn("more", F.lit(False)) for c in closed], open_rows.withColumn("more", F.lit(True)))
        ahead = ahead.select(F.col("id").alias("end"), F.col("end").alias("next"), F.col("hops").alias("n_hops"), "more", *[F.col(f"a_{w}").alias(f"n_{w}") for w in weights])
        moved = open_rows.join(ahead, "end").select("id", "parent", F.col("next").alias("end"), (F.col("hops") + F.col("n_hops")).alias("hops"), *_plus(("a_", "n_"), weights), *[f"u_{w}" for w in weights], "more")
        moved = materialise(moved)
        closed.append(moved.filter("not more").drop("more"))
        open_rows = moved.filter("more").drop("more")
        if not open_rows.limit(1).count():
            return reduce(DataFrame.unionByName, closed)
    raise ValueError("the parents run in a circle")


def subtree_totals(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """id and, under its own name, the sum of each weight over the node's subtree, itself included.

    `nodes` has id (unique, not null, of any type that can be joined), parent (null, or an id that isn't there: a root) and the
    columns `weights`, whose nulls count as 0.  A forest of any shape will do: depth costs rounds by its logarithm only, and a
    parent of any number of children sums them before the shuffle.  Circles raise an error, an empty table gives no rows.
    """
    live = materialise(nodes.select("id", "parent", *[F.coalesce(w, F.lit(0)).alias(f"a_{w}") for w in weights], *[F.lit(0).cast(nodes.schema[w].dataType).alias(f"u_{w}") for w in weights]))
    left, phases = live.count(), []
    while left:
        kids = live.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("kids"), F.max("id").alias("only"), *[F.max(f"u_{w}").alias(f"o_{w}") for w in weights])
        known = materialise(live.join(kids.withColumnRenamed("parent", "id"), "id", "left"))
        chains = None
        rest = known.filter("kids is null or kids > 1").drop("only", *[f"o_{w}" for w in weights])
        if known.filter("kids = 1").limit(1).count():
            chains = _compress(known.filter("kids = 1"), weights, left)
            # The head of a chain has the most hops; the chain's end gets its parent, and the edge between all that the chain has.
            head = F.max_by(F.struct("parent", *[(F.col(f"a_{w}") + F.col(f"u_{w}")).alias(f"h_{w}") for w in weights]), "hops").alias("head")
            heads = chains.groupBy("end").agg(head).withColumnRenamed("end", "id")
            linked = F.col("head").isNotNull()
            rest = materialise(rest.join(heads, "id", "left").select(
                "id", F.when(linked, F.col("head.parent")).otherwise(F.col("parent")).alias("parent"), "kids", *[f"a_{w}" for w in weights],
                *[F.when(linked, F.col(f"head.h_{w}")).otherwise(F.col(f"u_{w}")).alias(f"u_{w}") for w in weights],
            ))
        leaves = rest.filter("kids is null")
        raked = leaves.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(f"a_{w}") + F.col(f"u_{w}")).cast(nodes.schema[w].dataType).alias(f"n_{w}") for w in weights])
        grown = rest.filter("kids > 1").join(raked, "id", "left")
        live = materialise(grown.select("id", "parent", *[(F.col(f"a_{w}") + F.coalesce(f"n_{w}", F.lit(0))).alias(f"a_{w}") for w in weights], *[f"u_{w}" for w in weights]))
        phases.append((chains, leaves.select("id", *[F.col(f"a_{w}").alias(w) for w in weights])))
        before, left = left, live.count()
        if left == before:
            raise ValueError("the parents run in a circle")
    totals = None
    for chains, leaves in reversed(phases):
        totals = leaves if totals is None else totals.unionByName(leaves)
        if chains is not None:
            ends = totals.withColumnRenamed("id", "end")
            inner = chains.join(ends, "end").select("id", *[(F.col(f"a_{w}") + F.col(w)).alias(w) for w in weights])
            totals = materialise(totals.unionByName(inner))
    return totals if totals is not None else nodes.select("id", *weights)
