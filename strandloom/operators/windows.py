"""Polishing in windows: where edits would improve a draft, a window of it is polished exactly with its reads' pieces.

Every window of every draft is one draft of the exact loop, so windows of a long draft are polished side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import T16
from .align import edit_paths
from .assembly import sub_reads
from .edits import best_edits, choose_edits, merge_windows, part_tables
from .polish import polish, polish_exactly
from .tables import dealt, materialise

#: Positions that rest after an edit when windows are looked for, and a window's reach to either side of an edit.
REST, WIDTH = 20, 25


def split_windows(windows: DataFrame, width: int) -> DataFrame:
    """Windows (start, end, other columns) of 4 x `width` or more cut into pieces of 2 x `width`; the last piece is up to twice as long."""
    size = F.col("end") - F.col("start")
    pieces = F.when(size < 4 * width, F.lit(1)).otherwise(F.ceil(size / (2 * width)).cast("int") - 1)
    cut = windows.withColumn("__n", pieces).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    start = F.col("start") + F.col("__k") * 2 * width
    end = F.when(F.col("__k") == F.col("__n") - 1, F.col("end")).otherwise(start + 2 * width)
    return cut.select(*[start.alias(c) if c == "start" else end.alias(c) if c == "end" else F.col(c) for c in windows.columns])


def polish_windows(drafts: DataFrame, reads: DataFrame, windows: DataFrame, key: str, draft: str, read: str, path: str) -> DataFrame:
    """(key, draft, polished): windows (key, start, end) that don't overlap are polished exactly with the pieces of the reads
    that their paths put there, and spliced back.  Drafts without windows, and windows without pieces, stay as they are."""
    whole = drafts.select(key, F.col(draft).alias("draft"))
    own = materialise(windows.join(whole, key).select(key, "start", "end", F.concat_ws(":", key, "start").alias("__window"), F.substring("draft", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece")))
    spans = reads.join(own, key).select(
        F.col("__window").alias("template_id"), F.lit(0).alias("chunk_id"), F.lit(0).alias("read_id"), F.col(read).alias("seq"), F.col(path).alias("path"), F.lit(0).alias("start"),
        F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"),
    ).filter("path IS NOT NULL")
    pieces = sub_reads(spans).select(F.col("template_id").alias("__window"), "read")
    done = polish_exactly(own, pieces, "__window", "piece", "read").select("__window", "polished")
    spliced = own.join(done, "__window").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "polished"))).alias("w"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    grown = lambda s, w: F.struct(w["end"].cast("int").alias("at"), F.concat(s["out"], F.substring("draft", s["at"] + 1, w["start"] - s["at"]), w["polished"]).alias("out"))
    joined = F.aggregate("w", begin, grown, lambda s: F.concat(s["out"], F.substring("draft", s["at"] + 1, F.length("draft"))))
    return whole.join(spliced, key, "left").select(key, "draft", F.when(F.col("w").isNull(), F.col("draft")).otherwise(joined).alias("polished"))


def polish_focused(drafts: DataFrame, reads: DataFrame, key: str, draft: str, read: str, radius: int = 20, rest: int = REST, width: int = WIDTH) -> DataFrame:
    """(key, draft, polished): one pass over the windows around edits that would improve a draft, `rest` positions apart."""
    whole = drafts.select(key, F.col(draft).alias("draft"))
    pairs = reads.select(key, F.col(read).alias("read")).join(whole, key)
    pairs = materialise(edit_paths(dealt(pairs, key, "read"), "draft", "read", radius).select(key, "draft", "read", F.col("ops").alias("path")))
    tables, deep = part_tables(pairs, [key], "draft", "read", T16, radius, "path")
    chosen = choose_edits(whole, best_edits(tables, key, T16, deep=deep), None, key, "draft", T16, F.lit(rest))
    places = materialise(chosen.select(key, F.explode("edits.pos").alias("pos")))  # read twice
    merged = merge_windows(places, key, width).join(whole.select(key, F.length("draft").alias("__length")), key)
    inside = merged.select(key, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "__length").alias("end")).filter("start < end")
    return polish_windows(whole, pairs.select(key, "read", "path"), split_windows(inside, width), key, "draft", "read", "path")


def polish_banded(drafts: DataFrame, reads: DataFrame, key: str, draft: str, read: str, radius: int = 20) -> DataFrame:
    """(key, draft, polished, rounds): windows first, then rounds of edits over whole drafts."""
    first = materialise(polish_focused(drafts, reads, key, draft, read, radius))
    rounds = polish(first.select(key, "polished"), reads, key, "polished", read, radius).select(key, F.col("polished").alias("__last"), "rounds")
    return first.join(rounds, key).select(key, "draft", F.col("__last").alias("polished"), "rounds")
