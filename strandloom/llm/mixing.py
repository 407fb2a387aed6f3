"""Mixing sources to target weights, in DataFrame operations alone.

Temperature mixing: the shares of the sources' tokens are raised to an exponent between 0 (all alike) and 1 (as
they are), which is bisected inside one SQL expression over the array of shares.  The weights become a budget of
tokens a source, and the budget becomes whole epochs over the source plus one partial epoch, taken as the head of
a permutation of the source's blocks.  Blocks are hash buckets of documents, so a source of any size is dealt over
all of them and only (source, block) sums are ever ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

STEPS = 60
#: The plan has blocks x sources rows; it is broadcast only up to this many of them.
BROADCAST_ROWS = 200_000


def _hash_bits(*parts: Column) -> Column:
    """A 60-bit number from md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int, *carried: Column) -> DataFrame:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return df.select(*carried, source.alias("source"), F.pmod(_hash_bits(source, ident), F.lit(blocks)).alias("block"), tokens.alias("n_tokens"))


def exponent(shares: Column, times: Column, tokens: Column, target_entropy: float | None, max_epochs: float | None, budget_tokens: Column | None) -> Column:
    """The bisected exponent for an array of different positive shares, each of so many (`times`) sources of that many `tokens`.

    With `target_entropy` (a fraction of the largest possible one): the largest exponent whose weights reach it.
    With `max_epochs`: the smallest exponent that repeats no source more often, under `budget_tokens` or, without
    one, under the least budget that uses every source whole at least once.
    """
    zero = F.lit(0.0)

    def total(powers: Column) -> Column:
        return F.aggregate(F.zip_with(powers, times, lambda w, n: w * n), zero, lambda a, x: a + x)

    def reached(a: Column) -> Column:
        powers = F.transform(shares, lambda p: F.pow(p, a))
        if target_entropy is not None:
            norm = total(powers)
            parts = F.zip_with(powers, times, lambda w, n: n * (w / norm) * F.ln(w / norm))
            return -F.aggregate(parts, zero, lambda s, x: s + x) >= F.lit(target_entropy) * F.ln(F.aggregate(times, zero, lambda s, n: s + n)) - F.lit(1e-12)
        if budget_tokens is None:
            return F.pow(F.array_max(shares) / F.array_min(shares), F.lit(1.0) - a) <= F.lit(max_epochs)
        return F.array_max(F.zip_with(powers, tokens, lambda w, t: w / total(powers) * budget_tokens / t)) <= F.lit(max_epochs)

    start = F.struct(zero.alias("low"), F.lit(1.0).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        up = reached(mid) if target_entropy is not None else ~reached(mid)
        return F.struct(F.when(up, mid).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(mid).alias("high"))

    bisected = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    if target_entropy is not None:
        return F.when(reached(F.lit(1.0)), F.lit(1.0)).otherwise(F.round(bisected["low"], 9))
    return F.when(reached(F.lit(0.0)), F.lit(0.0)).otherwise(F.round(bisected["high"], 9))


def mixing_plan(keyed: DataFrame, target_entropy: float | None, max_epochs: float | None, budget: str) -> DataFrame:
    """One row for each (source, block): weight, copies of its documents, and the block's place in the permutation.

    Sources of equal size have equal weights, so the exponent is found on the different sizes: of N tokens in all
    there are at most the square root of 2 N, however many sources there are.  The plan's scalars come to the driver.
    """
    blocks = materialise(keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")))
    sources = blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens")).filter("tokens > 0")
    sizes = sources.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sort_array(F.collect_list(F.struct("tokens", "n"))).alias("all"), F.sum(F.col("tokens") * F.col("n")).alias("whole"))
    numbers = {"shares": lambda s: s["tokens"] / F.col("whole").cast("double"), "times": lambda s: s["n"].cast("double"), "counts": lambda s: s["tokens"].cast("double")}
    row = row.withColumns({name: F.transform("all", f) for name, f in numbers.items()})
    given = F.col("whole").cast("double") if budget == "total" else None
    row = row.withColumn("exponent", exponent(F.col("shares"), F.col("times"), F.col("counts"), target_entropy, max_epochs, given))
    row = row.withColumn("powers", F.transform("shares", lambda p: F.pow(p, F.col("exponent"))))
    row = row.withColumn("norm", F.aggregate(F.zip_with("powers", "times", lambda w, n: w * n), F.lit(0.0), lambda a, x: a + x))
    if budget == "total":
        row = row.withColumn("budget", F.col("whole").cast("double"))
    else:  # the least that uses every source whole; the small addition keeps rounding from costing a token
        row = row.withColumn("budget", F.array_max(F.zip_with("counts", "powers", lambda t, w: t / F.round(w / F.col("norm"), 12))) * F.lit(1 + 1e-9))
    plan = row.select("whole", "exponent", "norm", "budget").first()
    whole, power, norm, tokens = (F.lit(float(x or 0)) for x in plan)
    per = sources.withColumn("weight", F.round(F.pow(F.col("tokens") / whole, power) / norm, 12)).withColumn("drawn", F.floor(F.col("weight") * tokens))
    per = per.withColumns({"whole_epochs": F.expr("drawn div tokens"), "rest": F.expr("drawn % tokens")})
    planned = blocks.join(per, "source", "left")
    order = _hash_bits(F.col("source"), F.col("whole_epochs").cast("string"), F.col("block").cast("string"))
    spread = Window.partitionBy("source").orderBy(order, "block")
    planned = planned.withColumns({"block_rank": F.row_number().over(spread), "up_to": F.sum("block_tokens").over(spread.rowsBetween(Window.unboundedPreceding, 0))})
    copies = F.when(F.col("weight").isNull(), F.lit(1)).otherwise(F.col("whole_epochs") + F.when(F.col("up_to") <= F.col("rest"), 1).otherwise(0))
    return planned.select("source", "block", F.coalesce("weight", F.lit(0.0)).alias("weight"), copies.cast("long").alias("copies"), F.col("block_rank").cast("long").alias("block_rank"))


def _with_plan(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    plan = materialise(plan)
    return keyed.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, ["source", "block"])


def mix_report(df: DataFrame, target_entropy: float | None = None, max_epochs: float | None = None, budget: str = "total", blocks: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of `df`: doc_id, source, n_tokens, block, block_rank, weight, copies (0: not drawn).

    Give one of `target_entropy` and `max_epochs`.  `budget`: "total" draws as many tokens as there are, "whole" as
    many as it takes to use every source whole at least once.  A null source counts as the empty name, a null text
    as no tokens, a null id as the empty string.  Sources without tokens have weight 0 and are kept as they are.
    Repeated rows share a block and are drawn alike.  An empty table gives an empty result.
    """
    if (target_entropy is None) == (max_epochs is None):
        raise ValueError("give one of target_entropy and max_epochs")
    keyed = materialise(_keyed(df, id_col, text_col, source_col, blocks, F.col(id_col).alias("doc_id")))
    drawn = _with_plan(keyed, mixing_plan(keyed, target_entropy, max_epochs, budget))
    return drawn.select("doc_id", "source", "n_tokens", "block", "block_rank", F.round("weight", 9).alias("weight"), "copies")


def mix(df: DataFrame, target_entropy: float | None = None, max_epochs: float | None = None, budget: str = "whole", blocks: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `df`, each as often as the mixture draws it; columns as they are.  Cases as in mix_report."""
    if (target_entropy is None) == (max_epochs is None):
        raise ValueError("give one of target_entropy and max_epochs")
    # Whole rows travel as one column, so that none of theirs clashes with a name used here.
    keyed = _keyed(df, id_col, text_col, source_col, blocks, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    drawn = _with_plan(keyed.select("row", "source", "block"), mixing_plan(keyed.drop("row"), target_entropy, max_epochs, budget))
    epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return drawn.select("row", F.explode(epochs)).select("row.*")
