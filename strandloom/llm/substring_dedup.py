"""Substring dedup by level-wise doubling of repeated word windows.

Levels are lengths, each twice the one before, up to the window's own.  On each but the last a window is looked up by its
minimiser, the stretch of that length with the least hash inside it: equal windows have equal minimisers, so a window
can repeat only where its minimiser does, and only a fraction of the places is looked up.  Windows whose minimiser
repeats go on to twice the length; where none does, nothing goes on.  On the last level whole windows are looked up,
and all but the first occurrence of each mark the words they cover.  What repeats inside a batch is settled in the
batch, and one row for each window goes on, so a passage that very many documents share reaches the shuffle once a batch.

Texts are shuffled once, by id; the later looks at them use the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, row_chunks, runs_of, text_buffer, words

_U = np.uint64
_B = 0xA24BAED4963EE407
_TOP = _U(2**64 - 1)
#: Texts with a null id come after all others, by 56 bits of their hash from here on; real ids are below.
_NO_ID = 2**63 - 2**56
#: The shortest length that is looked up.
_LEAST = 5
#: Place of a word: texts with one id are told apart by the bits above.
_TEXT_SHIFT = 40
_FLUSH = 1 << 20


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each place on, by doubling; places near the end hold no full window."""
    out, done = np.zeros(len(h), np.uint64), 0
    power, size = h.copy(), 1
    rest = length
    while rest:
        if rest & 1:
            moved = np.zeros(len(h), np.uint64)
            if done < len(h):
                moved[: len(h) - done] = power[done:]
            out = out * _U(pow(_B, size, 1 << 64)) + moved
            done += size
        rest >>= 1
        if rest:
            moved = np.zeros(len(h), np.uint64)
            if size < len(h):
                moved[: len(h) - size] = power[size:]
            power = power * _U(pow(_B, size, 1 << 64)) + moved
            size *= 2
    return np.minimum(mix(out), _TOP - _U(1))


def _slide(x: np.ndarray, width: int, forward: bool, best: Callable, pad: int) -> np.ndarray:
    """best of x[i : i + width] (or of x[i - width + 1 : i + 1]) at each i."""
    def moved(y: np.ndarray, by: int) -> np.ndarray:
        out = np.full(len(y), pad, y.dtype)
        if by < len(y):
            if forward:
                out[: len(y) - by] = y[by:]
            else:
                out[by:] = y[: len(y) - by]
        return out

    size, out = 1, x
    while 2 * size <= width:
        out = best(out, moved(out, size))
        size *= 2
    return best(out, moved(out, width - size)) if size < width else out


class _Texts:
    """Streams (ids, text numbers, words) of batches sorted by (id, text); equal neighbours with one id share a number."""

    def __init__(self) -> None:
        self.last: tuple = (None, None, 0)

    def number(self, ids: list[int], texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        last_id, last_text, n = self.last
        for i, one in enumerate(ids):
            if one == last_id:
                text = texts[i].as_py()
                if last_text is None or text != last_text:
                    n += last_text is not None
                last_text = text
            else:
                last_id, n = one, 0
                last_text = texts[i].as_py() if i + 1 == len(ids) or ids[i + 1] == one else None
            out[i] = n
        if len(out) and out.max() >= 1 << 63 - _TEXT_SHIFT:
            raise ValueError(f"more than {1 << 63 - _TEXT_SHIFT} different texts with one id")
        self.last = (last_id, last_text, n)
        return out


def _by_word(batch: pa.RecordBatch, numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each word, place of each word, word hashes) of bounded pieces of a batch."""
    data, offsets = text_buffer(batch.column(1))
    for i, j in row_chunks(offsets):
        _, _, row, h = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        first = np.searchsorted(row, np.arange(j - i))
        place = np.arange(len(row)) - first[row] + (numbers[i:j][row] << _TEXT_SHIFT)
        yield i, j, row, place, h


def _valid(row: np.ndarray, length: int) -> np.ndarray:
    """Whether a window of `length` words from each word on stays in its row."""
    ok = np.zeros(len(row), bool)
    if len(row) >= length:
        ok[: len(row) - length + 1] = row[: len(row) - length + 1] == row[length - 1 :]
    return ok


def _levels(window: int) -> list[int]:
    lengths = [window]
    while lengths[0] // 2 >= _LEAST:
        lengths.insert(0, lengths[0] // 2)
    return lengths


def _least(h: np.ndarray, row: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each stretch of `length` words, and the least one inside the window that starts at each word."""
    code = np.where(_valid(row, length), window_hashes(h, length), _TOP)
    return code, _slide(code, window - length + 1, True, np.minimum, int(_TOP))


def _alive(code: np.ndarray, least: np.ndarray, survivor: np.ndarray, width: int) -> np.ndarray:
    """Which windows have a minimiser among the survivors."""
    return _slide(np.where(survivor, code, _TOP), width, True, np.minimum, int(_TOP)) == least


def _minimisers(code: np.ndarray, least: np.ndarray, alive: np.ndarray, width: int) -> np.ndarray:
    """Which stretches are the minimiser of a window that is alive: no least over a place exceeds its hash, so the largest
    of them equals it where any does."""
    return (_slide(np.where(alive, least, _U(0)), width, False, np.maximum, 0) == code) & (code != _TOP)


def _runs(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring places of one id as runs: ids, first places, lengths."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])  # a repeated row brings a place again
    ids, places = ids[new], places[new]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (places[1:] != places[:-1] + 1)
    starts = np.flatnonzero(new)
    return ids[starts], places[starts], np.diff(np.append(starts, len(ids)))


_ROWS = ["anchor", "key", "id", "place", "n"]


def _rows(anchor: np.ndarray, key: np.ndarray, ids: np.ndarray, place: np.ndarray, settled_ids: np.ndarray, settled: np.ndarray) -> pa.RecordBatch:
    """Windows to look for elsewhere (n is 0), and runs of n places already known, dealt by id."""
    known, start, n = _runs(settled_ids, settled)
    spread = mix(known.view(np.uint64)).view(np.int64)
    columns = ((anchor.view(np.int64), spread), (key.view(np.int64), np.zeros(len(n), np.int64)), (ids, known), (place, start), (np.zeros(len(key), np.int64), n))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=_ROWS)


def _gather(keep_first: bool):
    """From rows sorted by (key, anchor, id, place): the places of repeated ones, without the first of each unless `keep_first`.

    Windows are equal where the hash of all their words and that of their minimiser both are; shorter stretches have no
    key but their anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        last: tuple[tuple[int, int], int, int, bool] | None = None  # key, id and place of the row before, and whether it is out already

        def flush() -> pa.RecordBatch:
            found = _runs(np.concatenate(held_ids), np.concatenate(held))
            held_ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "place", "n"])

        for batch in batches:
            key, anchor, ids, place, n = (batch.column(c).to_numpy() for c in range(5))
            known = n > 0
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in (ids, place, n)], names=["id", "place", "n"])
            key, anchor, ids, place = key[~known], anchor[~known], ids[~known], place[~known]
            if not len(key):
                continue
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (anchor[1:] == anchor[:-1])
            if last is not None and (key[0], anchor[0]) == last[0]:
                same[0] = True
                if keep_first and not last[3]:
                    held_ids.append(np.array([last[1]]))
                    held.append(np.array([last[2]]))
            out = same.copy()
            if keep_first:
                out[:-1] |= same[1:]
            else:  # the same place again (a repeated row) isn't earlier than itself
                lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(key))))
                head_id = np.where(lead >= 0, ids[np.maximum(lead, 0)], last[1] if last else 0)
                head_place = np.where(lead >= 0, place[np.maximum(lead, 0)], last[2] if last else 0)
                out &= (ids != head_id) | (place != head_place)
            if keep_first:
                last = ((key[-1], anchor[-1]), int(ids[-1]), int(place[-1]), bool(out[-1]))
            elif not same[-1] or last is None or lead[-1] >= 0:
                last = ((key[-1], anchor[-1]), int(ids[lead[-1]]), int(place[lead[-1]]), True)
            held_ids.append(ids[out])
            held.append(place[out])
            if sum(map(len, held)) > _FLUSH:
                yield flush()
        if held:
            yield flush()

    return run


def _runs_by_row(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of (place, n): offsets of the rows, first places, lengths; null counts as an empty list."""
    sizes = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), flat.field("place").to_numpy(), flat.field("n").to_numpy()


def _anchors(code: np.ndarray, least: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """What windows are dealt by: the hash of their minimiser, and whether it stands in their first or second half.

    A common minimiser is so dealt to two tasks; neighbouring windows mostly stay together.
    """
    second = np.zeros(len(starts), bool)
    open_ = np.ones(len(starts), bool)
    for at in range(width):
        here = open_ & (code[starts + at] == least[starts])
        second[here] = 2 * at >= width
        open_ &= ~here
    return mix(least[starts] + second.astype(np.uint64))


def _candidates(window: int, before: int, length: int):
    """What to look up at `length` of texts (id, text), or of texts with the survivors of the level `before` (id, text, runs)."""
    final = length == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            numbers = texts.number(ids.tolist(), batch.column(1))
            runs_at, first_place, n_places = _runs_by_row(batch.column(2)) if before else (None, None, None)
            anchors, keys, owners, places = [], [], [], []
            for i, j, row, place, h in _by_word(batch, numbers):
                alive = _valid(row, window)
                if before:
                    survivor = np.zeros(len(row), bool)
                    spans = np.searchsorted(row, np.arange(j - i + 1))
                    for r in range(i, j):
                        a, b = spans[r - i], spans[r - i + 1]
                        own = slice(runs_at[r], runs_at[r + 1])
                        for start, n in zip(first_place[own].tolist(), n_places[own].tolist(), strict=True):
                            if start >> _TEXT_SHIFT == numbers[r]:
                                start &= (1 << _TEXT_SHIFT) - 1
                                survivor[a + start : min(a + start + n, b)] = True
                    last_code, last_least = _least(h, row, window, before)
                    alive &= _alive(last_code, last_least, survivor, window - before + 1)
                if final:
                    chosen = np.flatnonzero(alive)
                    code = window_hashes(h, window)
                    anchors.append(_anchors(last_code, last_least, chosen, window - before + 1) if before else code[chosen])
                else:
                    code, least = _least(h, row, window, length)
                    chosen = np.flatnonzero(_minimisers(code, least, alive, window - length + 1))
                    anchors.append(code[chosen])
                keys.append(code[chosen] if final else np.zeros(len(chosen), np.uint64))
                owners.append(ids[i:j][row[chosen]])
                places.append(place[chosen])
            if not keys:
                continue
            anchor, key, owner, place = np.concatenate(anchors), np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
            order = np.lexsort((place, owner, anchor, key))
            anchor, key, owner, place = anchor[order], key[order], owner[order], place[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1])
            first = np.append(np.flatnonzero(new), len(key))
            head = np.repeat(first[:-1], np.diff(first))
            # Of whole windows the later occurrences are known to go; of shorter stretches every one that repeats goes on.
            known = (owner != owner[head]) | (place != place[head]) if final else np.repeat(np.diff(first) > 1, np.diff(first))
            head = first[:-1][np.lexsort((place[first[:-1]], owner[first[:-1]]))]  # neighbours in a text stay neighbours
            yield _rows(anchor[head], key[head], owner[head], place[head], owner[known], place[known])

    return run


def _cut_out(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            numbers = texts.number(ids.tolist(), batch.column(1))
            runs_at, first_place, length = _runs_by_row(batch.column(2))
            data = batch.column(1)
            n_words, n_removed, digest, kept_text = [], [], [], []
            for r in range(len(ids)):
                parts = (data[r].as_py() or "").encode().split()
                own = slice(runs_at[r], runs_at[r + 1])
                start, n = first_place[own], length[own]
                mine = start >> _TEXT_SHIFT == numbers[r]
                start, n = start[mine] & ((1 << _TEXT_SHIFT) - 1), n[mine]
                total = len(parts)
                if len(start):
                    step = np.zeros(total + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + n + window - 1, -1)
                    parts = [parts[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                kept = b" ".join(parts)
                n_words.append(total)
                n_removed.append(total - len(parts))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=ids >= _NO_ID), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string()),
            ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes when a window of `window` words that covers it also starts earlier: in a smaller doc_id, or earlier
    in its own document.  Windows are judged on the input.  kept_text has the other words joined by single spaces.
    A null text has no words; a text shorter than the window is left alone.  Null ids come after all others, in the order
    of a hash of their texts; ids from 2^63 - 2^56 on are refused.  Rows that repeat an id and text are one document
    (each keeps the same words); other texts of a repeated id come later in the order of their bytes, up to 2^23 of
    them.  Texts of any length are read whole.  Empty tables give empty results; other columns are ignored.
    """
    if window < 4:
        raise ValueError("the window must have 4 words or more")
    given, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    beyond = F.raise_error(F.concat(F.lit("id too large: "), given.cast("string"))).cast("long")
    unnamed = F.lit(_NO_ID) + F.xxhash64(text).bitwiseAND((1 << 56) - 1)
    # Never null, and visibly so: else joins filter the texts first, and the looks at them no longer share one exchange.
    ident = F.coalesce(F.when(given.isNull(), unnamed).when(given >= _NO_ID, beyond).otherwise(given), F.lit(_NO_ID))
    texts = df.select(ident.alias("id"), text.alias("text")).repartition("id")
    rows, found = "anchor long, key long, id long, place long, n long", "id long, place long, n long"

    def settled(df: DataFrame, keep_first: bool) -> DataFrame:
        # Windows around one minimiser, which neighbour each other in their texts, go to one task; equal ones do too.
        dealt = df.repartition("anchor").sortWithinPartitions("key", "anchor", "id", "place").select("key", "anchor", "id", "place", "n")
        return dealt.mapInArrow(_gather(keep_first), found).groupBy("id").agg(F.collect_list(F.struct("place", "n")).alias("runs"))

    lengths = _levels(window)
    looked = texts.sortWithinPartitions("id", "text").mapInArrow(_candidates(window, 0, lengths[0]), rows)
    for before, length in pairwise(lengths):
        survivors = settled(looked, keep_first=True)
        looked = texts.join(survivors, "id").sortWithinPartitions("id", "text").mapInArrow(_candidates(window, before, length), rows)
    covered = settled(looked, keep_first=False)
    return texts.join(covered, "id", "left").sortWithinPartitions("id", "text").mapInArrow(_cut_out(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
