"""Shared pieces of the corpus operators: tables on the shared folder, Arrow text buffers, word hashing.

Texts reach the Python side as Arrow columns.  The helpers here work on the column's byte buffer as one
numpy array, so a batch of documents costs a few vector passes instead of a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word is a longest run of bytes outside this set (space, and tab to carriage return).
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Maps A-Z to a-z and leaves every other byte, so also all of UTF-8's longer sequences.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BLOCK = 1 << 20
_RADIX = 0x9E3779B97F4A7C15
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_CODE[SPACE] = 0
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(task: Callable) -> Callable:
    """A task function that gives freed memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


#: Ends a query's shuffle files with the query, on all executors; a session leaves them until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the `passing` blocks that are open, the inner ones last.
_open: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends, and losing an executor loses nothing."""
    return _written(df, _open[-1] if _open else f"{shared_dir(df.sparkSession)}/strandloom")


def _written(df: DataFrame, folder: str) -> DataFrame:
    spark, path = df.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `materialise` writes inside the block go at its end, all but those that it writes by the function it gets:
    those stay as long as tables of the block around it do."""
    outer = _open[-1] if _open else f"{shared_dir(spark)}/strandloom"
    folder = f"{outer}/{uuid.uuid4().hex}"
    _open.append(folder)
    try:
        yield lambda df: _written(df, outer)
    finally:
        _open.pop()
    _emptied(spark, folder)


def discard(table: DataFrame) -> None:
    """Give back the space of a table that `materialise` has written; nothing may read it, or what is made of it, any more."""
    _emptied(table.sparkSession, table.inputFiles()[0].rsplit("/", 1)[0])


def _emptied(spark: SparkSession, folder: str) -> None:
    spark.range(0).coalesce(1).write.mode("overwrite").parquet(folder)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as it takes to differ from every column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 arrays."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one row where that row alone is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, _BLOCK + 4096)
        inverse = pow(_RADIX, -1, 1 << 64)
        for name, base in (("up", _RADIX), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash of every word of a buffer of rows.

    The hash of a word is the difference of two prefix sums of a polynomial, scaled back by the inverse power,
    so it doesn't depend on where the word stands.
    """
    inside = ~SPACE[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # in blocks of whole words, so that the power tables stay small
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        lo, hi = start[i], end[j - 1]
        up, down = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        hashes[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return start, end, row, mix(hashes)


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal neighbours, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Regroup a partition sorted by `key` into tables that hold whole groups; a table may hold several."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = batch.num_rows
        last = [batch.column(k)[cut - 1] for k in key]
        same = np.ones(cut, bool)
        for k, value in zip(key, last, strict=True):
            same &= np.asarray(pc.equal(batch.column(k), value).fill_null(False)) if value.is_valid else np.asarray(batch.column(k).is_null())
        first = cut - int(np.argmin(same[::-1])) if not same.all() else 0
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = [batch.slice(first)]
        else:
            if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != v.as_py() for k, v in zip(key, last, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
