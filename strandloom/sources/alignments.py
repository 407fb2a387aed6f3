"""SAM text, headerless TSV clusters, sequence tables, and the text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import nonmatches, three_way
from ..operators.tables import materialise


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """q_name, r_name, flag, pos (1-based, 0 unmapped), cigar of the alignment lines of SAM text; lines that are short go."""
    fields = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("@")).filter(F.size(fields) >= 6)
    return lines.select(fields[0].alias("q_name"), fields[2].alias("r_name"), fields[1].try_cast("int").alias("flag"), fields[3].try_cast("int").alias("pos"), fields[5].alias("cigar")).filter("flag IS NOT NULL AND pos IS NOT NULL")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id and seq of FASTA records: records are split at the header mark, so a record may span any number of lines."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("record")).filter("record <> ''")
    head = F.split("record", "\r?\n", 2)
    return records.select(F.regexp_extract(head[0], r"^(\S*)", 1).alias("id"), F.upper(F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s", "")).alias("seq"))


def read_cluster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The draft (first line) and reads (others) of each headerless TSV file whose fourth column is the sequence: (file, idx, seq)
    each, with idx the line's number in its file.  Lines without a fourth column go, so a file whose first line has none has no draft.

    Files are read in byte ranges by many tasks.  The lines of a range are numbered as they are read and the ranges of a file put
    in order by their lines' counts; only those counts meet.  The numbered lines are written once, so that both look at them see
    the same ranges.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.get(F.split("value", "\t"), F.lit(3)).alias("seq"),
    )
    numbered = materialise(lines)
    ranges = numbered.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("file", "block", (before - F.col("first")).alias("shift"))
    rows = numbered.filter("seq IS NOT NULL").join(starts, ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("idx"), "seq")
    return rows.filter("idx = 0"), rows.filter("idx > 0")


def write_timings(rows: DataFrame, path: str) -> None:
    """Rows as headerless TSV, such as (microseconds, residual errors) of a polishing run."""
    rows.write.option("sep", "\t").csv(path)


def rendered(pairs: DataFrame, reference: str, query: str, path: str, width: int = 200, worse_than: int = 500) -> DataFrame:
    """`text`: wrapped three-row alignments of the pairs with more than so many steps that aren't matches."""
    wrapped = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(width)), lambda i: F.substring(c, i, F.lit(width)))
    shown = pairs.filter(nonmatches(F.col(path)) > worse_than).withColumn("__a", three_way(F.col(reference), F.col(query), F.col(path)))
    lines = F.arrays_zip(wrapped(F.col("__a.ref")).alias("r"), wrapped(F.col("__a.mid")).alias("m"), wrapped(F.col("__a.query")).alias("q"))
    return shown.withColumn("text", F.array_join(F.transform(lines, lambda z: F.concat_ws("\n", z["r"], z["m"], z["q"])), "\n\n")).drop("__a")
