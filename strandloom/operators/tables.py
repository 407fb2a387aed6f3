"""Tables on the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reads, and bases of reads, in a part of a draft beyond which it has more parts.
PART_READS, PART_BASES = 2048, 1 << 20
#: Rows that one task sorts.
SORT_ROWS = 500_000


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to the session's number of partitions: a small file is one task, however much work its rows are."""
    return df.repartition(partitions(df), *keys)


def sortable(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key, as many partitions as give a task about SORT_ROWS of them, whatever the size of the table."""
    return df.repartition(max(partitions(df), -(-df.count() // SORT_ROWS)), key)


def spread(df: DataFrame, key: str, read: str) -> DataFrame:
    """Rows dealt by key, a fixed number of partitions: the work of a row is far larger than its bytes, so small partitions aren't
    to be put together.  A draft is one part, so its tables add up in one place; one with more than PART_READS reads (or PART_BASES
    bases) has so many that each has about as many."""
    return spread_parts(df, key, read)[0].drop("__parts")


def spread_parts(df: DataFrame, key: str, read: str) -> tuple[DataFrame, bool]:
    """As `spread`, sorted by key and part in each partition, with the number of the draft's parts (__parts); and whether any has
    more than one."""
    many = F.greatest(F.ceil(F.count(F.lit(1)) / PART_READS), F.ceil(F.sum(F.length(read)) / PART_BASES))
    parts = materialise(df.groupBy(key).agg(many.cast("long").alias("__parts")).filter(F.col("__parts") > 1))
    deep, one = bool(parts.limit(1).count()), F.lit(1).cast("long")
    own = df.join(parts, key, "left").withColumn("__parts", F.coalesce("__parts", one)) if deep else df.withColumn("__parts", one)
    by = [F.col(key), F.pmod(F.xxhash64(read), F.col("__parts"))] if deep else [F.col(key)]
    return own.repartition(partitions(df), *by).sortWithinPartitions(*by), deep


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` under spark.checkpoint.dir (set here only where it is unset) and read it back: lineage ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/strandloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
