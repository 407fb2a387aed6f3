"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters on (leading bytes, digest, id), sorted inside each
partition by Spark's external sort, and compared with their neighbours, whole text against whole text.  The id
is part of the splitters, so a group of copies of any size is dealt over as many partitions as it needs; the at
most two runs that touch the ends of a partition are joined up afterwards through a table of two rows a
partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialise, text_buffer

#: Ids to drop are broadcast up to this many, else joined by a shuffle.
BROADCAST_ROWS = 500_000

_LEAD = 16
_KEYED = "id long, lead binary, digest binary, norm binary"
_RUNS = "id long, text_sha256 string, keep_id long, group_size long, chosen boolean, edge long, edge_text binary"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        data = LOWER[data]
        raw = memoryview(data)
        at = offsets.tolist()
        digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at, at[1:], strict=False)]
        lead = [bytes(raw[a : min(b, a + _LEAD)]) for a, b in zip(at, at[1:], strict=False)]
        norm = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(digest), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        if len(data) < 2**31:
            norm = norm.cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lead, pa.binary()), pa.array(digest, pa.binary()), norm], names=["id", "lead", "digest", "norm"])


def _compare_neighbours(largest: bool):
    def run_rows(ids: list, digest: bytes, edge: int | None, text: bytes) -> dict:
        n = len(ids)
        at = n - 1 if largest else 0
        return {
            "id": ids, "text_sha256": [digest.hex()] * n, "keep_id": [ids[at]] * n, "group_size": [n] * n, "chosen": [i == at for i in range(n)],
            "edge": [edge] * n, "edge_text": [text if edge is not None and i == at else None for i in range(n)],
        }

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([("id", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("chosen", pa.bool_()), ("edge", pa.int64()), ("edge_text", pa.binary())])
        ids: list = []
        text, digest, runs = b"", b"", 0
        out: dict[str, list] = {f.name: [] for f in schema}

        def close(edge: int | None) -> None:
            for name, values in run_rows(ids, digest, edge, text).items():
                out[name].extend(values)

        for batch in batches:
            own, digests, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for i, (one, sha) in enumerate(zip(own, digests, strict=True)):
                if ids and sha == digest and texts[i].as_py() == text:
                    ids.append(one)
                    continue
                if ids:
                    close(2 * part if runs == 0 else None)
                    runs += 1
                ids, digest, text = [one], sha, texts[i].as_py()
            yield pa.RecordBatch.from_pydict(out, schema)
            out = {f.name: [] for f in schema}
        if ids:
            close(2 * part if runs == 0 else 2 * part + 1)
            yield pa.RecordBatch.from_pydict(out, schema)

    return compare


def content_sort_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each row of `df`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  A null text counts as empty.  `keep` is "smallest" or
    "largest": the id of the row that stays.  Null ids lose to any id; of rows that tie (the same id and text
    again, or only null ids) exactly one stays.  An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    largest = keep == "largest"
    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_normalise, _KEYED)
    by_id = F.col("id").asc_nulls_first() if largest else F.col("id").asc_nulls_last()
    ordered = keyed.repartitionByRange("lead", "digest", by_id).sortWithinPartitions("lead", "digest", "norm", by_id)
    runs = materialise(ordered.mapInArrow(_compare_neighbours(largest), _RUNS))

    # Two rows a partition at most: the runs at its ends, which may go on in the next one.
    ends = runs.filter("edge_text is not null").groupBy("edge_text").agg(
        F.collect_list("edge").alias("edges"), F.sum("group_size").alias("whole_size"),
        (F.max_by if largest else F.min_by)("keep_id", "edge").alias("whole_keep"), (F.max if largest else F.min)("edge").alias("winner"),
    )
    ends = ends.filter(F.size("edges") > 1).select(F.explode("edges").alias("edge"), "whole_size", "whole_keep", "winner")
    joined = runs.join(F.broadcast(ends), "edge", "left")
    spans = F.col("winner").isNotNull()
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(spans, F.col("whole_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("whole_size", "group_size").alias("group_size"),
        (F.col("chosen") & (~spans | (F.col("edge") == F.col("winner")))).alias("kept"),
        "text_sha256",
    )


def without_ids(df: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `df` whose id isn't in the one column of `gone`; rows with a null id stay."""
    gone = materialise(gone.toDF(id_col).distinct())
    few = gone.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `df` that content_sort_dedup keeps, with all their columns.

    Ids are taken to tell rows apart.  Where they don't (a repeated or null id), the rows of that id are told apart by
    their texts, and one row of each text kept under that id stays.
    """
    found = materialise(content_sort_dedup(df, id_col, text_col, keep).select("doc_id", "kept", "text_sha256"))
    per = found.groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count(F.lit(1)).alias("n"))
    odd = materialise(per.filter("doc_id is null or n > 1 and stay between 1 and n - 1").select("doc_id"))
    rest = without_ids(df.filter(F.col(id_col).isNotNull()), per.filter("stay = 0").select("doc_id").unionByName(odd), id_col)
    if not odd.limit(1).count():
        return rest
    kept = found.filter("kept").join(odd, found["doc_id"].eqNullSafe(odd["doc_id"]), "left_semi").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, lower), 256)
    # Whole rows as one column, so that none of theirs clashes with a name used here.
    same = df.select(F.col(id_col).alias("id"), sha.alias("sha"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    same = same.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, same["id"].eqNullSafe(kept["id"]) & (same["sha"] == kept["sha"]), "left_semi").dropDuplicates(["id", "sha"])
    return rest.unionByName(same.select("row.*"))
