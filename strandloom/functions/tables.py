"""Table functions for SQL callers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class SubReads:
    """The pieces of one aligned read in the chunks of its template that it spans whole; see `register`."""

    def eval(self, seq: str, path: str, start: int, length: int, chunk_size: int, overlap: int) -> Iterator[tuple]:
        if None in (seq, path, start, length):
            return
        stride, ops = chunk_size - overlap, np.frombuffer(path.encode(), np.uint8)
        on_reference = np.flatnonzero(ops != ord("I"))
        query = np.concatenate([[0], np.cumsum(ops != ord("D"))])
        last = max((length - chunk_size) // stride, 0)
        for chunk in range(max(-(-start // stride), 0), last + 1):
            begin, end = chunk * stride, length if chunk == last else chunk * stride + chunk_size
            if end > start + len(on_reference):
                break
            if begin >= end:
                continue
            first, upto = on_reference[begin - start], on_reference[end - 1 - start] + 1
            if query[upto] > query[first]:
                yield chunk, seq[query[first] : query[upto]], path[first:upto]


def register(spark: SparkSession) -> None:
    """Makes `strandloom_sub_reads(seq, path, start, template_length, chunk_size, overlap)` known to the session's SQL.

    It gives (chunk_id int, read string, path string), a row for each chunk that a read spans whole, as `assembly.sub_reads`
    does after `assembly.spanned_chunks`; call it with LATERAL.  A null argument gives no row.  DataFrame callers should take
    those two, which stay in the JVM.
    """
    spark.udtf.register("strandloom_sub_reads", udtf(SubReads, returnType="chunk_id int, read string, path string"))
