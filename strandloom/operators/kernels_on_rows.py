"""Runs kernels over rows: Arrow batches in, Arrow batches out, the columns named by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

#: Table cells that one kernel call may hold at once.
CELLS = 2_000_000
#: Pairs of different lengths share a call where the longest is so many times, and steps more than, the shortest.
SLACK, PADS = 1.125, 8


def map_rows(df: DataFrame, keep: list[str], inputs: list[str], outputs: str, kernel: Callable[[pd.DataFrame], tuple[np.ndarray, pd.DataFrame]], runs: str | None = None) -> DataFrame:
    """`keep` columns of `df` with the columns `outputs` (DDL) of a kernel.

    The kernel gets a frame of the `inputs` (columns 0, 1, ...) and returns, for each row of its result, the place of
    the row it comes from, and the result's columns; so a row can give none or many.  Rows sorted by a column `runs` reach it with
    all of a value together.
    """
    chosen = df.select(*keep, *[F.col(c).alias(f"__{k}") for k, c in enumerate(inputs)])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keep)])
    schema = ", ".join(x for x in (kept, outputs) if x)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames if runs is None else _whole_runs(frames, runs):
            own = frame[[f"__{k}" for k in range(len(inputs))]].set_axis(range(len(inputs)), axis=1).reset_index(drop=True)
            rows, out = kernel(own)
            yield pd.concat([frame[keep].iloc[rows].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return chosen.mapInPandas(run, schema)


def _whole_runs(frames: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The same rows in frames that end where the column's value changes."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[column].iloc[-1]
        other = np.flatnonzero((frame[column].notna() if pd.isna(last) else frame[column] != last).to_numpy())
        first = int(other[-1]) + 1 if len(other) else 0
        if not first and held:
            before = held[-1][column].iloc[-1]
            if before != last and not (pd.isna(before) and pd.isna(last)):
                yield pd.concat(held, ignore_index=True)
                held = []
        if first:
            yield pd.concat([*held, frame.iloc[:first]], ignore_index=True)
            held = []
        held.append(frame.iloc[first:])
    if held:
        yield pd.concat(held, ignore_index=True)


def each_row(names: list[str], kernel: Callable[..., list[tuple]]) -> Callable[[pd.DataFrame], tuple[np.ndarray, pd.DataFrame]]:
    """A kernel of frames from one of rows, which returns a list of tuples for each."""

    def run(frame: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        found = [kernel(*row) for row in frame.itertuples(index=False, name=None)]
        rows = np.repeat(np.arange(len(frame)), [len(f) for f in found]).astype(int)
        columns = zip(*(r for f in found for r in f), strict=True) if len(rows) else [()] * len(names)
        return rows, pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns, strict=True)})

    return run


def along_diagonal(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with a path along the diagonal, as `bootstrap_path` has it, for each pair in columns 0 and 1 as column 2."""
    frame = frame.copy(deep=False)
    frame[2] = pd.Series([None if pd.isna(x) or pd.isna(y) else K.diagonal_path(len(x), len(y)) for x, y in zip(frame[0], frame[1], strict=True)], dtype=object, index=frame.index)
    return frame


def by_shape(frame: pd.DataFrame, radius: int | None, cells: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, K.Band]]:
    """Pairs of equal lengths together: (places, references, queries, band) of a frame whose columns 0, 1 and, with a radius, 2
    are reference, query and path; rows with a null sequence are left out, a null path follows the diagonal."""
    for places, x, y, band, _ in padded(frame, radius, 1, cells=cells):
        yield places, x, y, band


def padded(frame: pd.DataFrame, radius: int | None, slack: float = SLACK, mixed: bool = False, cells: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, K.Band, list[int]]]:
    """As `by_shape`, but pairs whose lengths differ alike, and are up to `slack` times (and PADS steps) those of the shortest, go
    together: each begins with as many PAD codes in both sequences as it is short, the last of what is given.

    With `mixed` lengths may also differ by different numbers, of as many steps: a query that is short by more than its reference
    has SKIP codes before its pads, so its own bases are its last ones.  What a pair's table has from its own bases on is its own;
    only affine scores and training can't take such pairs.
    """
    good = np.flatnonzero((frame[0].notna() & frame[1].notna()).to_numpy())
    refs, queries = frame[0].to_numpy(), frame[1].to_numpy()
    alike: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
    for k in good.tolist():
        n, m = len(refs[k]), len(queries[k])
        # A band of that radius would hold the whole table.
        alike.setdefault((0 if mixed else m - n, radius is not None and 2 * radius < max(n, m)), []).append((n, m - n, k))
    for (_, banded), found in alike.items():
        found.sort()
        at = 0
        while at < len(found):
            shortest = found[at][0]
            longest, end = shortest * slack + (PADS if slack > 1 else 0), at
            least = most = found[at][1]
            while end < len(found) and found[end][0] <= longest:
                n, more = found[end][:2]
                if max(most, more) - min(least, more) > longest - shortest:
                    break
                least, most = min(least, more), max(most, more)
                end += 1
                if (end - at) * (n + most + 1) * (min(n + 1, 4 * radius + 2) if banded else n + 1) >= (cells or CELLS):
                    break
            some = [k for _, _, k in found[at:end]]
            n = found[end - 1][0]
            m = n + most
            pads = [n - own for own, _, _ in found[at:end]]
            skips = [most - more for _, more, _ in found[at:end]]
            yield np.array(some), _coded(refs, some, n), _coded(queries, some, m, skips), _band(frame, some, pads, skips, n, m, radius if banded else None), pads
            at = end


def _coded(column: np.ndarray, some: list[int], width: int, skips: list[int] | None = None) -> np.ndarray:
    own = column[some].tolist()
    out, place = np.full((len(own), width), K.PAD, np.uint8), np.arange(width)
    out[place >= width - np.array([len(s) for s in own])[:, None]] = K.codes("".join(own))
    if skips:
        out[place < np.array(skips)[:, None]] = K.SKIP
    return out


def _band(frame: pd.DataFrame, some: list[int], pads: list[int], skips: list[int], n: int, m: int, radius: int | None) -> K.Band:
    if radius is None:
        return K.Band.full(len(some), n, m)
    straight = {kind: K.straight_path(n - kind[0], m - kind[0] - kind[1]) for kind in set(zip(pads, skips, strict=True))}
    whole = ["I" * skip + "=" * pad + (own or straight[pad, skip]) for own, pad, skip in zip(frame[2].to_numpy()[some].tolist(), pads, skips, strict=True)]
    return K.Band.around(whole, n, m, radius)
