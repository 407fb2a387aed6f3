"""Sharding by extendible hashing, in DataFrame operations alone.

The directory is indexed by the leading bits of a 60-bit hash of the id.  Only buckets over the byte limit split on
another bit.  Bits are opened a page at a time: one aggregation gives the bytes of every prefix of a page, levels
above are sums of it, and only what is still too large after a page goes on to the next, so the work past the first
page is on the oversized part and no directory page has more than 2**PAGE_BITS entries for each bucket it opens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

HASH_BITS = 60
PAGE_BITS = 12
BROADCAST_ROWS = 200_000


def _prefix(depth: int) -> Column:
    return F.shiftright(F.col("hash"), HASH_BITS - depth)


def _page(open_rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Buckets that fit, and at the last depth those that don't: prefix, depth, shard_bytes, shard_docs, whether it fits."""
    fine = materialise(open_rows.groupBy(_prefix(high).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("h0"), F.max("hash").alias("h1")))
    sums = [
        fine.groupBy(F.shiftright("fine", high - depth).alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("h0").alias("h0"), F.max("h1").alias("h1")).withColumn("depth", F.lit(depth))
        for depth in range(low, high + 1)
    ]
    every = reduce(DataFrame.unionByName, sums).withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("h0") == F.col("h1")) | (F.col("depth") == HASH_BITS))
    # A bucket exists if its parent had to split; the root of the page always exists.
    parent = every.select(F.col("prefix").alias("up"), (F.col("depth") + 1).alias("down"), F.col("fits").alias("parent_fits"))
    born = every.join(parent, (F.shiftright(every["prefix"], 1) == parent["up"]) & (every["depth"] == parent["down"]), "left")
    return born.filter((F.col("depth") == low) | (F.col("parent_fits") == F.lit(False))).filter(F.col("fits") | (F.col("depth") == high)).select("prefix", "depth", "shard_bytes", "shard_docs", "fits")


def shard_report(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, n_bytes, shard (the bits of its prefix), depth, shard_bytes, shard_docs.

    Every shard holds at most `limit` bytes of text, unless all of its rows have one id (or a single text is longer):
    such rows can't be split and make a shard of their own.  A null text has 0 bytes and a null id counts as the empty string.  An empty
    table gives an empty result; other columns are ignored.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = materialise(df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(ident), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
    ))
    done: list[DataFrame] = []
    low, open_rows = 0, rows
    while True:
        high = min(low + PAGE_BITS, HASH_BITS)
        buckets = materialise(_page(open_rows, low, high, limit))
        # The page of the directory: each bucket stands at all entries that begin with its bits.
        entries = buckets.withColumn("entry", F.expr(f"explode(sequence(shiftleft(prefix, {high} - depth), shiftleft(prefix + 1, {high} - depth) - 1))"))
        small = buckets.agg(F.expr(f"sum(shiftleft(1L, {high} - depth))")).first()[0] or 0
        found = open_rows.withColumn("entry", _prefix(high)).join(F.broadcast(entries) if small <= BROADCAST_ROWS else entries, "entry")
        done.append(found.filter("fits"))
        if high == HASH_BITS or not buckets.filter("not fits").limit(1).count():
            break
        open_rows = materialise(found.filter("not fits").select(*rows.columns))
        low = high
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), "0"))
    return reduce(DataFrame.unionByName, done).select("doc_id", "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def write_shards(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `df` as one folder for each shard under `path` (the root bucket, without bits, is folder shard=all).

    The folders are named after a column `shard`, with underscores before it where `df` has one of that name.
    """
    folder, key = unused(df, "shard"), unused(df, "shard_id")
    shards = shard_report(df, limit, id_col, text_col).select(F.col("doc_id").alias(key), F.when(F.col("shard") == "", "all").otherwise(F.col("shard")).alias(folder)).distinct()
    joined = df.join(shards, F.col(id_col).eqNullSafe(F.col(key))).drop(key)
    joined.repartition(folder).write.partitionBy(folder).parquet(path)
