"""Edit-score tables of a stream of reads: the native table, kept up to date as reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import Layout
from ..operators.edits import all_edits


def streaming_table(drafts: DataFrame, reads: DataFrame, key: str, draft: str, read: str, layout: Layout) -> DataFrame:
    """Running sums (key, pos, slot, score, reads) over streamed reads joined to a static table of drafts.

    State is one sum for each cell of a draft's table, so it grows with the drafts, not with the reads; write it in
    update or complete mode.
    """
    edits = all_edits(drafts, key, draft, layout)
    scored = reads.select(key, read).join(edits, key).withColumn("d", F.levenshtein("edited", read).cast("long"))
    return scored.groupBy(key, "pos", "slot").agg(F.sum("d").alias("score"), F.count(F.lit(1)).alias("reads"))
