"""Best-fit packing of token sequences by exact-complement hashing.

Texts become pieces of at most `size` tokens in one pass.  The plan needs only how many pieces there are of each
length, `size` numbers however large the corpus: single, pair and triple sums of lengths are looked up to fill a
gap exactly under the counts that are left, else the longest length that fits is taken.  A pattern is repeated as
often as its counts allow, so the plan is short.  Pieces then find their place through their rank within their
length, which is counted per salt so that a common length is spread over many tasks.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Characters on whose classes every regex engine agrees; other texts go to the reference tokenizer itself.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
_loaded: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of the vocabulary file at `path` (tokenizers JSON), those of its added tokens included.  With `ranks` (the
    same vocabulary as tiktoken ranks) texts of plain characters without an added token take tiktoken's path, which
    gives the same ids about four times as fast."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.added = [token.content for token in self.exact.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.quick is not None and not _PLAIN.search(text) and not any(token in text for token in self.added):
            return np.asarray(self.quick.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str, ranks: str | None) -> Encoder:
    key = f"{path}|{ranks}"
    if key not in _loaded:
        _loaded[key] = Encoder(path, ranks)
    return _loaded[key]


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences at the end, the shorter rest first."""
    first = n if n <= size else n % size or size
    yield 0, first
    for at in range(first, n, size):
        yield at, size


def token_pieces(df: DataFrame, path: str, ranks: str | None, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; the ids of a text end with id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            seen: dict[str, list[tuple[int, int, int, int]]] = {}
            out: list[list] = [[], [], [], [], []]
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if text not in seen:
                    ids = np.append(encode(text), np.uint32(0)).astype("<u4")
                    seen[text] = [(k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), size))]
                for row in seen[text]:
                    for values, value in zip(out, (one, *row), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _fill_exactly(left: np.ndarray, gap: int) -> list[int]:
    """One, two or three available lengths that add up to `gap`, longest first; empty if there are none."""
    if left[gap] > 0:
        return [gap]

    def pair(total: int) -> list[int]:
        big = np.arange((total + 1) // 2, total)
        fits = (left[big] > 0) & (left[total - big] > 0)
        if total % 2 == 0 and len(big):
            fits[0] = left[total // 2] > 1
        return [int(big[fits][-1]), total - int(big[fits][-1])] if fits.any() else []

    if found := pair(gap):
        return found
    present = (left[: gap + 1] > 0).astype(np.float32)
    sums = np.convolve(present, present)[: gap + 1] > 0.5  # which totals two lengths reach
    for a in np.flatnonzero((left[:gap] > 0) & sums[gap - np.arange(gap)])[::-1].tolist():
        left[a] -= 1
        found = pair(gap - a)
        left[a] += 1
        if found:
            return sorted([a, *found], reverse=True)
    return []


def plan_patterns(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in each) that use up `counts`; lengths run from 1 to `size`."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    while left.any():
        pattern: list[int] = []
        rest, gap = left.copy(), size
        while gap:
            more = _fill_exactly(rest, gap) if pattern else []
            fitting = np.flatnonzero(rest[: gap + 1])
            if not more and not len(fitting):
                break
            for length in more or [int(fitting[-1])]:
                pattern.append(length)
                rest[length] -= 1
                gap -= length
        used = Counter(pattern)
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        patterns.append((times, sorted(pattern, reverse=True)))
    return patterns


def place_pieces(pieces: DataFrame, size: int, rows_per_salt: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    slots, sequence, ranks = [], 0, Counter()
    for times, pattern in plan_patterns(counts, size):
        offset = 0
        for length, n in Counter(pattern).items():  # in the pattern's order, equal lengths side by side
            slots.append((length, ranks[length], sequence, n, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    starts = table[:, 0] * (1 << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = table[np.searchsorted(starts, length * (1 << 48) + rank, "right") - 1]
            k = rank - slot[:, 1]
            found = [slot[:, 2] + k // slot[:, 3], slot[:, 4] + k % slot[:, 3] * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x, pa.int64()) for x in found)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    salts = max(16, sum(counts.values()) // rows_per_salt)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before.select("length", "salt", "before"), ["length", "salt"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*columns, (F.coalesce("before", F.lit(0)) + F.col("within") - 1).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(df: DataFrame, path: str, ranks: str | None = None, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id 0.  A text of more than `size` ids is cut into pieces of `size`, the
    first of which may be shorter; other texts stay whole.  Repeated rows (the same id and text again) are packed
    as often as they occur.  An empty table gives an empty result; other columns are ignored.
    """
    return place_pieces(materialise(token_pieces(df, path, ranks, size, id_col, text_col)), size)
