"""Dynamic-programming cores that run inside tasks, on numpy rows.

Sequences are arrays of codes 0 to 3.  Tables have a row for each query position; of a row only a window of columns
(reference positions) is stored and computed, whose place a `Band` gives, so time and memory go with the query's length
times the window's width.  A row is one vector pass over many pairs of the same two lengths, which are neighbours in memory: what runs
along the row (a deletion after a deletion) is a prefix minimum, a prefix maximum or a doubling sum instead of a loop.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

_CODE = np.zeros(256, np.uint8)
_CODE[[ord("C"), ord("c")]], _CODE[[ord("G"), ord("g")]], _CODE[[ord("T"), ord("t")]] = 1, 2, 3
FAR = np.int64(10**9)
#: Tables of distances have 32 bits: two of these still add up in them.
_FAR = np.int32(FAR)
#: Those of short pairs have 16, in which this is too far.
_NEAR = 10_000
#: Of fewer pairs than this, paths are traced back one by one.
FEW = 64
#: Code of what is put before both sequences of a pair to give it the lengths of longer ones: it meets only itself, at no cost, so
#: a best path, and any path that counts, passes through the corner behind it.
PAD = 4
#: Code of what is put before that in a query that is short by more than its reference: a row of it is the row before it again.
SKIP = 5


def codes(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def path_bands(paths: list[str], n: int, m: int, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end column (pairs, rows) within `radius` steps of the cells of paths (followed straight on past their ends).

    The radius may differ by row (pairs or 1, rows): a cell then reaches as far as its own row's.
    """
    first, last = np.full((len(paths), m + 1), n + 1), np.full((len(paths), m + 1), -1)
    for p, path in enumerate(paths):
        ops = np.frombuffer(path.encode(), np.uint8)
        row, column = np.cumsum(ops != ord("D")), np.cumsum(ops != ord("I"))
        row, column = np.concatenate([[0], row]), np.concatenate([[0], column])
        if row[-1] < m or column[-1] < n:
            on = np.arange(1, max(m - row[-1], n - column[-1]) + 1)
            row, column = np.concatenate([row, np.minimum(row[-1] + on, m)]), np.concatenate([column, np.minimum(column[-1] + on, n)])
        inside = (row <= m) & (column <= n)
        row, column = row[inside], column[inside]
        last[p, row] = column  # the largest of a row comes last
        first[p, row[::-1]] = column[::-1]
    low, high = np.full(first.shape, n + 1), np.zeros(first.shape, np.int64)
    radius = np.broadcast_to(radius, first.shape)
    for shift in range(-int(radius.max()), int(radius.max()) + 1):
        reach = radius - abs(shift)
        to, at = (slice(shift, None), slice(None, m + 1 - shift)) if shift >= 0 else (slice(None, m + 1 + shift), slice(-shift, None))
        if m + 1 <= abs(shift):
            continue
        np.minimum(low[:, to], np.where(reach >= 0, np.maximum(first - reach, 0), n + 1)[:, at], out=low[:, to])
        np.maximum(high[:, to], np.where(reach >= 0, np.minimum(last + reach, n) + 1, 0)[:, at], out=high[:, to])
    return np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1], np.maximum.accumulate(high, 1)


class Band:
    """The window of each row: `width` columns from starts[pair, row] on.  The first window starts with column 0, the last one
    ends with the last column, and starts never go back.

    Rows of values have (..., columns, pairs) here, so that a pass over many pairs is over neighbours.  Windows of more than half
    of a row aren't cut out: rows are whole then, and what is `outside` (rows, columns, pairs) of them doesn't count.
    """

    def __init__(self, starts: np.ndarray, width: int, outside: np.ndarray | None = None):
        self.starts, self.width, self.outside = starts, width, outside
        self._k, self._still = np.arange(width)[:, None], not starts.any()

    @classmethod
    def full(cls, pairs: int, n: int, m: int) -> Band:
        return cls(np.zeros((pairs, m + 1), np.int64), n + 1)

    @classmethod
    def around(cls, paths: list[str | None], n: int, m: int, radius: int | list[np.ndarray]) -> Band:
        """Within `radius` steps (or a radius for each row) of each pair's path; a missing path follows the diagonal."""
        radius = np.asarray(radius)
        spelled = [straight_path(n, m) if p is None else p.replace("X", "=") for p in paths]
        if radius.ndim > 1 and len(radius) > 1:
            low, high = path_bands(spelled, n, m, radius)
        else:  # short paths are much alike
            places: dict[str, int] = {}
            own = [places.setdefault(p, len(places)) for p in spelled]
            low, high = (z[own] for z in path_bands(list(places), n, m, radius))
        width = int(min(n + 1, (high - low).max())) if len(spelled) else n + 1
        starts = np.clip(low, 0, n + 1 - width)
        if width == n + 1 or 2 * width <= n + 1:
            return cls(starts, width)
        first, column = np.ascontiguousarray(starts.T)[:, None], np.arange(n + 1)[:, None]
        return cls(np.zeros_like(starts), n + 1, (column < first) | (column >= first + width))

    def reversed(self, n: int) -> Band:
        return Band((n + 1 - self.width - self.starts)[:, ::-1], self.width, None if self.outside is None else self.outside[::-1, ::-1])

    def of(self, values: np.ndarray, i: int) -> np.ndarray:
        """Values by column (n + 1, pairs) at the columns of row i."""
        if self.width == len(values):
            return values
        return np.take_along_axis(values, self.starts[:, i] + self._k, 0)

    def moved(self, row: np.ndarray, i: int, to: int, by: int, fill: float) -> np.ndarray:
        """What row i (..., width, pairs) holds at the columns of row `to` plus `by`."""
        if self._still:
            return shifted(row, by, fill)
        step = self.starts[:, to] - self.starts[:, i] + by
        some = np.unique(step)
        if len(some) < 5:
            out = shifted(row, int(some[0]) if len(some) else 0, fill)
            for other in some[1:].tolist():
                out = np.where(step == other, shifted(row, other, fill), out)
            return out
        at = self._k + step
        inside = (at >= 0) & (at < self.width)
        found = np.take_along_axis(row, np.broadcast_to(np.where(inside, at, 0), row.shape), -2)
        return np.where(inside, found, fill)

    def cut(self, row: np.ndarray, i: int, fill: float) -> None:
        """Row i (..., width, pairs) outside of its windows becomes `fill`."""
        if self.outside is not None:
            np.copyto(row, fill, where=self.outside[i])


def shifted(row: np.ndarray, by: int, fill: float) -> np.ndarray:
    """row[..., k + by, :] at each k."""
    if not by:
        return row
    out = np.empty_like(row)
    if by > 0:
        out[..., : max(row.shape[-2] - by, 0), :] = row[..., by:, :]
        out[..., max(row.shape[-2] - by, 0) :, :] = fill
    else:
        out[..., -by:, :] = row[..., :by, :]
        out[..., :-by, :] = fill
    return out


def _prefixes(how: np.ufunc, row: np.ndarray) -> np.ndarray:
    """The least or largest value up to each column of (columns, pairs); of many pairs by doubling, a pass over all of them at a time."""
    if row.shape[-1] < FEW:
        return how.accumulate(row, axis=0)
    step = 1
    while step < len(row):
        how(row[step:], row[:-step], out=row[step:])
        step *= 2
    return row


def straight_path(n: int, m: int) -> str:
    """Steps near the diagonal: a match for each base of the shorter one, the rest spread evenly."""
    short = min(n, m)
    extra = np.diff(np.arange(short + 1) * abs(n - m) // max(short, 1)) if short else np.array([abs(n - m)])
    gap = "D" if n > m else "I"
    return "".join(("=" if short else "") + gap * int(k) for k in extra)


@lru_cache(4096)
def diagonal_path(n: int, m: int) -> str:
    """As `sequences.bootstrap_path`: reference position round(q * n / m) after q query bases."""
    moves = np.diff([math.floor(q * n / m + 0.5) if q else 0 for q in range(m + 1)]).tolist()
    return "".join("=" + "D" * (move - 1) if move else "I" for move in moves) if m else "D" * n


def adapted_radius(radius: np.ndarray, path: str, edits: list[int], default: int) -> np.ndarray:
    """A radius for each row for the next round: half of the last one (at least 4), and the default again within `default`
    rows of where the path meets a reference position that was edited."""
    ops = np.frombuffer(path.encode(), np.uint8)
    row = np.cumsum(ops != ord("D"))[ops != ord("I")]  # the query position of each reference base
    out = np.maximum(radius // 2, 4)
    for pos in edits:
        at = int(row[min(pos, len(row) - 1)]) if len(row) else 0
        out[max(0, at - default) : at + default + 1] = default
    return out


def _many(x: np.ndarray) -> np.ndarray:
    return x if x.ndim > 1 else x[None]


def distance_table(reference: np.ndarray, query: np.ndarray, band: Band | None = None) -> np.ndarray:
    """Edit distances of all prefixes: rows by query, columns by reference (of each row's window).

    Like the other tables it takes many pairs of the same two lengths at once, in a leading axis.
    """
    x, y = _many(reference), _many(query)
    table, far = _distances(x, y, band or Band.full(len(x), x.shape[-1], y.shape[-1]))
    out = np.moveaxis(_far(table, far), -1, 0)
    return out if reference.ndim > 1 else out[0]


def _distances(x: np.ndarray, y: np.ndarray, band: Band) -> tuple[np.ndarray, int]:
    """Distances (rows, window, pairs) in as few bits as hold them, and what is FAR there: two of it still add up in them."""
    n, m = x.shape[-1], y.shape[-1]
    dtype, far = (np.int16, _NEAR) if n + m < _NEAR // 2 else (np.int32, int(_FAR))
    k = np.arange(band.width, dtype=dtype)[:, None]
    before, query = np.full((n + 1, len(x)), 9, np.uint8), np.ascontiguousarray(y.T)
    before[1:] = x.T
    out = np.empty((m + 1, band.width, len(x)), dtype)
    out[0] = k
    band.cut(out[0], 0, far)
    for i in range(1, m + 1):
        above = out[i - 1]
        row = band.moved(above, i - 1, i, 0, far) + (query[i - 1] != SKIP)
        np.minimum(row, band.moved(above, i - 1, i, -1, far) + (band.of(before, i) != query[i - 1]), out=row)
        row -= k
        row = _prefixes(np.minimum, row)
        row += k
        np.minimum(row, far, out=out[i])
        band.cut(out[i], i, far)
    return out, far


def _far(values: np.ndarray, far: int) -> np.ndarray:
    """Distances in 32 bits, with FAR as it is elsewhere."""
    return values if values.dtype == np.int32 else np.where(values >= far, _FAR, values.astype(np.int32))


def distance_path(table: np.ndarray, reference: np.ndarray, query: np.ndarray, order: str = "DI=", starts: np.ndarray | None = None) -> str | None:
    """A path of least distance; `order` says which step is taken first on ties, looking back from the end.

    `starts` has the first column of each row of a banded table; None comes back where the band holds no path.
    """
    j, i = len(reference), len(query)
    first = np.zeros(i + 1, np.int64) if starts is None else starts
    width = table.shape[-1]

    def at(i: int, j: int) -> int:
        return int(table[i, j - first[i]]) if i >= 0 and 0 <= j - first[i] < width else int(FAR)

    out = []
    while i or j:
        here = at(i, j)
        if here >= FAR:
            return None
        for op in order:
            if op == "D" and j and here == at(i, j - 1) + 1:
                j -= 1
                out.append("D")
                break
            if op == "I" and i and here == at(i - 1, j) + 1:
                i -= 1
                out.append("I")
                break
            if op == "=" and i and j and here == at(i - 1, j - 1) + int(reference[j - 1] != query[i - 1]):
                i, j = i - 1, j - 1
                out.append("=" if reference[j] == query[i] else "X")
                break
    return "".join(reversed(out))


def _spelled(steps: np.ndarray, length: np.ndarray, lost: np.ndarray) -> list[str | None]:
    """Paths from steps (pairs, looking back from the end)."""
    return [None if gone else row[:n][::-1].tobytes().decode() for row, n, gone in zip(steps, length.tolist(), lost.tolist(), strict=True)]


def distance_paths(tables: np.ndarray, references: np.ndarray, queries: np.ndarray, order: str, starts: np.ndarray, rows: np.ndarray, pads: np.ndarray) -> list[str | None]:
    """`distance_path` of many pairs of one table at once: a step back is one vector pass over all that aren't done.

    A pair's own bases begin behind `rows` of its query and `pads` of its reference.
    """
    many, (n, m), width = len(tables), (references.shape[-1], queries.shape[-1]), tables.shape[-1]
    if many < FEW:
        return [distance_path(tables[q, row:], references[q, pad:], queries[q, row:], order, starts[q, row:] - pad) for q, (row, pad) in enumerate(zip(rows.tolist(), pads.tolist(), strict=True))]
    steps, length, lost = np.zeros((many, n + m), np.uint8), np.zeros(many, np.int64), np.zeros(many, bool)
    p, i, j = np.arange(many), np.full(many, m), np.full(many, n)

    def at(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = j - starts[p, i]
        return np.where((k >= 0) & (k < width), tables[p, i, np.clip(k, 0, width - 1)], FAR)

    while True:
        on = (i > rows[p]) | (j > pads[p])
        p, i, j = p[on], i[on], j[on]
        if not len(p):
            return _spelled(steps, length, lost)
        here, inner_i, inner_j = at(p, i, j), i > rows[p], j > pads[p]
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        if m and n:
            unlike = references[p, left] != queries[p, up]
            across = inner_i & inner_j & (here == at(p, up, left) + unlike)
        else:
            unlike = across = np.zeros(len(p), bool)
        may = {"D": inner_j & (here == at(p, i, left) + 1), "I": inner_i & (here == at(p, up, j) + 1), "=": across}
        taken = np.select([may[op] for op in order], [ord(op) for op in order], 0)
        out = (here >= FAR) | (taken == 0)
        lost[p[out]] = True
        steps[p, length[p]] = np.where((taken == ord("=")) & unlike, ord("X"), taken)
        length[p] += 1
        i, j = i - (taken != ord("D")), j - (taken != ord("I"))
        p, i, j = p[~out], i[~out], j[~out]


def _put(out: np.ndarray, band: Band, i: int, row: np.ndarray, how: np.ufunc) -> None:
    """out[slot, column, pair] = how(itself, row[slot, window, pair]) at the columns of row i."""
    at = np.broadcast_to(band.starts[:, i] + np.arange(band.width)[:, None], row.shape)
    np.put_along_axis(out, at, how(np.take_along_axis(out, at, -2), row), -2)


def edit_table(reference: np.ndarray, query: np.ndarray, copies: int, deletions: int, band: Band | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance, and the distance after each edit of the reference: (len(reference) + 1) x slots, FAR where impossible.

    A path crosses each reference position once, so an edit's distance is a least sum of a prefix and a suffix distance.
    """
    x, y = _many(reference), _many(query)
    n, m = x.shape[-1], y.shape[-1]
    band = band or Band.full(len(x), n, m)
    before, far = _distances(x, y, band)
    after = _distances(x[:, ::-1], y[:, ::-1], band.reversed(n))[0][::-1, ::-1]
    unlike = (y.T[:, None, None] != np.arange(4)[:, None, None]).astype(before.dtype)
    slots, whole = 8 + copies + deletions, band.width == n + 1
    # The last two slots have what a new base costs, in the place of another or before it, that meets no query base.
    out = np.full((slots + 2, n + 1, len(x)), far, before.dtype)
    row = out if whole else np.empty((slots + 2, band.width, len(x)), before.dtype)
    for i in range(m + 1):
        here, rest = before[i], after[i]
        if not whole:
            row[:] = far
        for at, gone, every in ((0, 1, slots), (4, 0, slots + 1)):
            np.minimum(row[every], here + shifted(rest, gone, far) + 1, out=row[every])
            if i < m:  # the new base meets query base i: at no cost if it is the same one
                go = here + band.moved(after[i + 1], i + 1, i, gone, far)
                np.minimum(row[at : at + 4], go + unlike[i], out=row[at : at + 4])
        for c in range(1, copies + 1):
            np.minimum(row[7 + c], shifted(here, c, far) + rest, out=row[7 + c])
        for d in range(1, deletions + 1):
            np.minimum(row[7 + copies + d], here + shifted(rest, d, far), out=row[7 + copies + d])
        if not whole:
            _put(out, band, i, row, np.minimum)
    for at, every in ((0, slots), (4, slots + 1)):
        np.minimum(out[at : at + 4], out[every], out=out[at : at + 4])
    total, table = _far(before[-1, -1], far), np.moveaxis(_far(np.minimum(out[:slots], far), far), (0, 1, 2), (2, 1, 0))
    return (total, table) if reference.ndim > 1 else (total[0], table[0])


def affine(reference: np.ndarray, query: np.ndarray, scores: tuple[int, int, int, int], mode: str = "global", band: Band | None = None) -> tuple[int, int, int, int, int, str]:
    """The alignment of one pair; see affine_pairs."""
    return affine_pairs(reference[None], query[None], scores, mode, band)[0]


def affine_pairs(reference: np.ndarray, query: np.ndarray, scores: tuple[int, int, int, int], mode: str = "global", band: Band | None = None) -> list[tuple[int, int, int, int, int, str]]:
    """Score, start and end in the reference and the query, and path, for (match, mismatch, open, extend) scores.

    A gap of n costs open + (n - 1) extend; a deletion may follow an insertion but not the other way round.  Modes:
    global; local; infix (reference ends are free); overlap (the start of the reference and the end of the query are
    free: its suffix meets the query's prefix).
    """
    match, mismatch, gap_open, extend = scores
    pairs, n, m = len(reference), reference.shape[-1], query.shape[-1]
    band = band or Band.full(pairs, n, m)
    low, k = -FAR, np.arange(band.width)[:, None]
    base, bases = np.full((n + 1, pairs), 9, np.uint8), np.ascontiguousarray(query.T)
    base[1:] = reference.T
    rows = np.full((3, m + 1, band.width, pairs), low)  # after a match, an insertion, a deletion
    free_start = mode in ("infix", "overlap", "local")
    for i in range(m + 1):
        M, I, D = rows[:, i]
        if i == 0:
            M[:] = 0 if free_start else low
            M[0] = 0
        else:
            above = rows[:, i - 1]
            M[:] = band.moved(above.max(0), i - 1, i, -1, low) + np.where(band.of(base, i) == bases[i - 1], match, mismatch)
            M[band.of(base, i) == 9] = low
            I[:] = np.maximum(band.moved(above[0], i - 1, i, 0, low) + gap_open, band.moved(above[1], i - 1, i, 0, low) + extend)
            if mode == "local":
                np.maximum(M, 0, out=M)
                np.maximum(I, 0, out=I)
        opened = np.full((band.width, pairs), low)
        opened[1:] = np.maximum(M[:-1], I[:-1]) + gap_open
        if free_start and i == 0:
            opened[:] = low
        D[:] = _prefixes(np.maximum, opened - k * extend) + k * extend
        if mode == "local":
            np.maximum(D, 0, out=D)
        np.maximum(rows[:, i], low, out=rows[:, i])
        band.cut(rows[:, i], i, low)
    planes = np.moveaxis(rows, -1, 1)
    if pairs < FEW or not n or not m:
        return [_affine_path(planes[:, p], band.starts[p], reference[p], query[p], scores, mode) for p in range(pairs)]
    return _affine_paths(planes, band.starts, reference, query, gap_open, mode)


def _affine_paths(planes: np.ndarray, starts: np.ndarray, references: np.ndarray, queries: np.ndarray, gap_open: int, mode: str) -> list[tuple[int, int, int, int, int, str]]:
    """`_affine_path` of many pairs of one table at once: a step back is one vector pass over all that aren't done."""
    (many, n), m, width = references.shape, queries.shape[-1], planes.shape[-1]
    p = every = np.arange(many)

    def cells(p: np.ndarray, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = at - starts[p, i]
        return np.where((k >= 0) & (k < width), planes[:, p, i, np.clip(k, 0, width - 1)], -FAR)

    i, at = np.full(many, m), np.full(many, n)
    if mode == "infix":
        at = planes[:, :, m].max(0).argmax(-1) + starts[:, m]
    elif mode == "overlap":
        reach = n - starts
        i = np.where(reach < width, np.take_along_axis(planes.max(0), np.minimum(reach, width - 1)[..., None], -1)[..., 0], -FAR).argmax(-1)
    elif mode == "local":
        i, k = np.divmod(planes.max(0).reshape(many, -1).argmax(-1), width)
        at = k + starts[every, i]
    end_i, end_at, begin = i, at, np.zeros((2, many), np.int64)
    found = cells(p, i, at)
    state = found.argmax(0)
    score = value = found[state, every]
    steps, length = np.zeros((many, n + m), np.uint8), np.zeros(many, np.int64)
    while len(p):
        on = (i > 0) | (at > 0) if mode == "global" else i > 0
        if mode == "local":
            on &= value != 0
        begin[:, p[~on]] = i[~on], at[~on]
        p, i, at, state, value = p[on], i[on], at[on], state[on], value[on]
        match, gone = state == 0, state == 2
        unlike = references[p, np.maximum(at - 1, 0)] != queries[p, np.maximum(i - 1, 0)]
        steps[p, length[p]] = np.select([match & unlike, match, gone], [ord("X"), ord("="), ord("D")], ord("I"))
        length[p] += 1
        i, at = i - ~gone, at - (match | gone)
        found = cells(p, i, at)
        opened = found + gap_open == value
        after = np.where(opened[0], 0, np.where(gone & ~opened[1], 2, 1))
        state = np.where(match, found.argmax(0), after)
        value = found[state, np.arange(len(p))]
    paths = _spelled(steps, length, np.zeros(many, bool))
    if mode == "infix":
        paths = ["D" * lead + path + "D" * (n - end) for lead, path, end in zip(begin[1].tolist(), paths, end_at.tolist(), strict=True)]
    elif mode == "overlap":
        paths = ["D" * lead + path + "I" * (m - end) for lead, path, end in zip(begin[1].tolist(), paths, end_i.tolist(), strict=True)]
    return list(zip(score.tolist(), begin[1].tolist(), end_at.tolist(), begin[0].tolist(), end_i.tolist(), paths, strict=True))


def _affine_path(planes: np.ndarray, starts: np.ndarray, reference: np.ndarray, query: np.ndarray, scores: tuple[int, int, int, int], mode: str) -> tuple[int, int, int, int, int, str]:
    _, _, gap_open, _ = scores
    n, m, width = len(reference), len(query), planes.shape[-1]
    top = planes.max(0)

    def cell(state: int, i: int, j: int) -> int:
        return int(planes[state, i, j - starts[i]]) if 0 <= j - starts[i] < width else -int(FAR)

    def best(i: int, j: int) -> int:
        return int(np.argmax([cell(s, i, j) for s in range(3)]))

    if mode == "global":
        i, j_end = m, n
    elif mode == "infix":
        i, j_end = m, int(top[m].argmax() + starts[m])
    elif mode == "overlap":
        reach = n - starts
        i, j_end = int(np.where(reach < width, top[np.arange(m + 1), np.minimum(reach, width - 1)], -FAR).argmax()), n
    else:
        i, k = divmod(int(top.argmax()), width)
        j_end = int(k + starts[i])
    at, end_i = j_end, i
    state = best(i, at)
    score = cell(state, i, at)
    out: list[str] = []
    while i or at:
        value = cell(state, i, at)
        if mode == "local" and value == 0 or mode != "global" and i == 0:
            break
        if state == 0:
            op = "=" if reference[at - 1] == query[i - 1] else "X"
            i, at = i - 1, at - 1
            state = best(i, at)
        elif state == 1:
            op = "I"
            i -= 1
            state = 0 if cell(0, i, at) + gap_open == value else 1
        else:
            op = "D"
            at -= 1
            state = 0 if cell(0, i, at) + gap_open == value else 1 if cell(1, i, at) + gap_open == value else 2
        out.append(op)
    path = "".join(reversed(out))
    if mode == "infix":
        path = "D" * at + path + "D" * (n - j_end)
    elif mode == "overlap":
        path = "D" * at + path + "I" * (m - end_i)
    return score, at, j_end, i, end_i, path


#: Forward and backward log-likelihoods of a read that differ by more than this can't be trusted.
AGREE = 1e-4


def _skip(row: np.ndarray, table: np.ndarray, y: np.ndarray, band: Band, i: int, to: int, fill: float) -> None:
    """Where the query has SKIP, `row`, which is row `to` of a table of three states, becomes its row i again."""
    pairs = np.flatnonzero(y == SKIP)
    if len(pairs):
        row[..., pairs] = band.moved(table[:, i], i, to, 0, fill)[..., pairs]


def _into(t: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The three states' values, each times its transition, added up."""
    return t[0] * rows[0] + t[1] * rows[1] + t[2] * rows[2]


class PairModel:
    """Pair-HMM: transitions between match, insertion and deletion, and emissions.

    `emit[4 * reference + query]` for matches, `insert[4 * previous query base + query]` for insertions, whose last four
    are for the first base.
    """

    def __init__(self, transitions: np.ndarray, emit: np.ndarray, insert: np.ndarray):
        self.t = np.asarray(transitions, float).reshape(3, 3)
        self.e = np.asarray(emit, float).reshape(4, 4)
        self.i = np.asarray(insert, float).reshape(5, 4)
        # With PAD: two that meet make up for the step from match to match, and what follows one is a first base.
        self._emit, self._insert = np.zeros((5, 6)), np.zeros((6, 6))
        self._emit[:4, :4], self._insert[:5, :4], self._insert[SKIP, :4] = self.e, self.i, self.i[4]
        if self.t[0, 0] > 0:
            self._emit[PAD, PAD] = 1 / self.t[0, 0]

    def _insertions(self, query: np.ndarray) -> np.ndarray:
        """Emission of each query base as an insertion."""
        previous = np.full(query.shape, 4)
        previous[:, 1:] = query[:, :-1]
        return self._insert[previous, query]

    def forward(self, reference: np.ndarray, query: np.ndarray, band: Band | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Table (state, pairs, query, window) scaled by row, and the log of each row's scale so far."""
        x, y = _many(reference), _many(query)
        f, scale = self._forward(x, y, band or Band.full(len(x), x.shape[-1], y.shape[-1]))
        f, scale = np.moveaxis(f, -1, 1), scale.T
        return (f, scale) if reference.ndim > 1 else (f[:, 0], scale[0])

    def _forward(self, x: np.ndarray, y: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray]:
        """As `forward`, with pairs last: (state, query, window, pairs) and (query, pairs)."""
        m, t, insert = y.shape[-1], self.t, self._insertions(y).T
        emit = self._emissions(np.concatenate([x[:, :1], x], 1) if x.shape[-1] else np.zeros((len(x), 1), np.uint8), y, band)
        f, scale = np.zeros((3, m + 1, band.width, len(x))), np.zeros((m + 1, len(x)))
        for i in range(m + 1):
            row = f[:, i]
            if i == 0:
                row[0, 0] = 1
            else:
                above = f[:, i - 1]
                np.multiply(band.moved(_into(t[:, 0], above), i - 1, i, -1, 0.0), emit(i, i - 1), out=row[0])
                np.multiply(band.moved(_into(t[:, 1], above), i - 1, i, 0, 0.0), insert[i - 1], out=row[1])
                band.cut(row, i, 0.0)
            row[2] = _decayed_sum(shifted(t[0, 2] * row[0] + t[1, 2] * row[1], -1, 0.0), t[2, 2])
            band.cut(row[2], i, 0.0)
            if i:
                _skip(row, f, y[:, i - 1], band, i - 1, i, 0.0)
            total = row.sum((0, 1))
            row /= np.where(total > 0, total, 1)
            with np.errstate(divide="ignore"):
                scale[i] = (scale[i - 1] if i else 0.0) + np.log(total)
        return f, scale

    def _emissions(self, x: np.ndarray, y: np.ndarray, band: Band) -> Callable[[int, int], np.ndarray]:
        """What the columns of row i emit with the query base at a position: (window, pairs)."""
        places, flat = np.ascontiguousarray(x.T, np.intp) * self._emit.shape[1], self._emit.ravel()
        bases = np.ascontiguousarray(y.T, np.intp)
        return lambda i, at: flat.take(band.of(places, i) + bases[at])

    def _steps_from(self, b: np.ndarray, emit: Callable[[int, int], np.ndarray], insert: np.ndarray, band: Band, i: int) -> tuple[np.ndarray, np.ndarray]:
        """What follows a match, and an insertion, of query base i from each cell of row i."""
        match = band.moved(b[0, i + 1], i + 1, i, 1, 0.0) * emit(i, i)
        return match, band.moved(b[1, i + 1], i + 1, i, 0, 0.0) * insert[i]

    def backward(self, reference: np.ndarray, query: np.ndarray, band: Band | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Table of what may follow each cell, scaled by row, and the log of each row's scale from the end."""
        x, y = _many(reference), _many(query)
        b, scale = self._backward(x, y, band or Band.full(len(x), x.shape[-1], y.shape[-1]))
        b, scale = np.moveaxis(b, -1, 1), scale.T
        return (b, scale) if reference.ndim > 1 else (b[:, 0], scale[0])

    def _after(self, x: np.ndarray) -> np.ndarray:
        """The reference base behind each column."""
        return np.concatenate([x, x[:, -1:]], 1) if x.shape[-1] else np.zeros((len(x), 1), np.uint8)

    def _backward(self, x: np.ndarray, y: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray]:
        m, t, insert, emit = y.shape[-1], self.t, self._insertions(y).T, self._emissions(self._after(x), y, band)
        b, scale = np.zeros((3, m + 1, band.width, len(x))), np.zeros((m + 1, len(x)))
        for i in range(m, -1, -1):
            row = b[:, i]
            if i == m:
                row[:, -1] = 1
            else:
                match, insertion = self._steps_from(b, emit, insert, band, i)
                for s in range(3):
                    np.add(t[s, 0] * match, t[s, 1] * insertion, out=row[s])
                band.cut(row, i, 0.0)
            row[2] = _decayed_sum(row[2, ::-1], t[2, 2])[::-1]
            band.cut(row[2], i, 0.0)
            for s in (0, 1):
                row[s] += t[s, 2] * shifted(row[2], 1, 0.0)
            band.cut(row[:2], i, 0.0)
            if i < m:
                _skip(row, b, y[:, i], band, i + 1, i, 0.0)
            total = row.sum((0, 1))
            row /= np.where(total > 0, total, 1)
            with np.errstate(divide="ignore"):
                scale[i] = (scale[i + 1] if i < m else 0.0) + np.log(total)
        return b, scale

    def likelihood(self, reference: np.ndarray, query: np.ndarray, band: Band | None = None) -> np.ndarray:
        """Log of the sum over all paths (in the band)."""
        x, y = _many(reference), _many(query)
        f, scale = self._forward(x, y, band or Band.full(len(x), x.shape[-1], y.shape[-1]))
        with np.errstate(divide="ignore"):
            out = scale[-1] + np.log(f[:, -1, -1].sum(0))
        return out if reference.ndim > 1 else out[0]

    def edit_table(self, reference: np.ndarray, query: np.ndarray, copies: int, deletions: int, band: Band | None = None, back: bool = False) -> tuple[np.ndarray, ...]:
        """Log-likelihood, and that after each edit of the reference: (len(reference) + 1) x slots, -inf where impossible.

        With `back` also the log-likelihood as it comes out of the backward table, which equals the first up to rounding.

        A path enters each reference position once, by a match or a deletion: the products of what comes before the
        entry and what follows it add up to the edited likelihood.
        """
        x, y = _many(reference), _many(query)
        n, m = x.shape[-1], y.shape[-1]
        band = band or Band.full(len(x), n, m)
        f, up = self._forward(x, y, band)
        b, down = self._backward(x, y, band)
        t, emissions = self.t, self._emissions(self._after(x), y, band)
        same, onward = up + down, up[:-1] + down[1:]  # log scales of rows that meet: the same one, or the next
        both = np.concatenate([same, onward])
        top = np.where(np.isfinite(both), both, -1e300).max(0)
        with np.errstate(invalid="ignore"):
            at_same, at_next = (np.nan_to_num(np.exp(z - top)) for z in (same, onward))
        at_same[:-1][y.T == SKIP], at_next[y.T == SKIP] = 0, 0  # the same row follows, and counts
        slots, whole = 8 + copies + deletions, band.width == n + 1
        # The last two slots have what a new base, in the place of another or before it, adds as a deletion.
        out = np.zeros((slots + 2, n + 1, len(x)))
        row = out if whole else np.empty((slots + 2, band.width, len(x)))
        for i in range(m + 1):
            here, follow = f[:, i], b[2, i]
            if not whole:
                row[:] = 0
            to_delete = _into(t[:, 2], here) * at_same[i]
            row[slots] += to_delete * shifted(follow, 1, 0.0)
            row[slots + 1] += to_delete * follow
            if i < m:
                to_match = _into(t[:, 0], here) * at_next[i]
                matched = [band.moved(b[0, i + 1], i + 1, i, d, 0.0) for d in range(max(2, deletions + 2))]
                emit = self._emit[:4, y[:, i], None].transpose(0, 2, 1)
                for at, gone in ((0, 1), (4, 0)):
                    row[at : at + 4] += emit * (to_match * matched[gone])
                own = emissions(i, i)
            arrived = here[0::2] * at_same[i]  # entries of a column; insertions after them are part of what follows
            for c in range(1, copies + 1):
                row[7 + c] += (shifted(arrived, c, 0.0) * b[0::2, i]).sum(0)
            for d in range(1, deletions + 1):
                row[7 + copies + d] += to_delete * shifted(follow, d + 1, 0.0)
                if i < m:
                    row[7 + copies + d] += to_match * shifted(own, d, 0.0) * matched[d + 1]
            if not whole:
                _put(out, band, i, row, np.add)
        out[:4] += out[slots]
        out[4:8] += out[slots + 1]
        for d in range(1, min(deletions, n) + 1):  # of the last bases: nothing follows
            if d < band.width:
                out[7 + copies + d, n - d] = f[:, m, -1 - d].sum(0) * np.exp(up[m] - top)
        with np.errstate(divide="ignore"):
            total, table = up[-1] + np.log(f[:, -1, -1].sum(0)), np.moveaxis(np.log(out[:slots]) + top, (0, 1, 2), (2, 1, 0))
            behind = down[0] + np.log(b[0, 0, 0])
        found = (total, table, behind) if back else (total, table)
        return found if reference.ndim > 1 else tuple(z[0] for z in found)

    def viterbi_table(self, reference: np.ndarray, query: np.ndarray, band: Band | None = None) -> np.ndarray:
        """Log-likelihoods of the best paths into each cell: (state, pairs, query, window)."""
        x, y = _many(reference), _many(query)
        n, m = x.shape[-1], y.shape[-1]
        band = band or Band.full(len(x), n, m)
        with np.errstate(divide="ignore"):
            t, e, insert = np.log(self.t), np.log(self._emit), np.log(self._insertions(y)).T
        if self.t[0, 0] > 0:
            e[PAD, PAD] = -t[0, 0]  # adds up to nothing without rounding, so ties stay ties
        before = np.ascontiguousarray((np.concatenate([x[:, :1], x], 1) if n else np.zeros((len(x), 1), np.uint8)).T, np.intp) * e.shape[1]
        bases, e = np.ascontiguousarray(y.T, np.intp), e.ravel()
        k = np.arange(band.width)[:, None]
        v = np.full((3, m + 1, band.width, len(x)), -np.inf)
        into = lambda s, above: np.maximum(np.maximum(t[0, s] + above[0], t[1, s] + above[1]), t[2, s] + above[2])
        for i in range(m + 1):
            row = v[:, i]
            if i == 0:
                row[0, 0] = 0
            else:
                above = v[:, i - 1]
                row[0] = band.moved(into(0, above), i - 1, i, -1, -np.inf) + e.take(band.of(before, i) + bases[i - 1])
                row[1] = band.moved(into(1, above), i - 1, i, 0, -np.inf) + insert[i - 1]
                band.cut(row, i, -np.inf)
            arrive = shifted(np.maximum(t[0, 2] + row[0], t[1, 2] + row[1]), -1, -np.inf)
            row[2] = _prefixes(np.maximum, arrive - k * t[2, 2]) + k * t[2, 2] if np.isfinite(t[2, 2]) else arrive
            band.cut(row[2], i, -np.inf)
            if i:
                _skip(row, v, y[:, i - 1], band, i - 1, i, -np.inf)
        v = np.moveaxis(v, -1, 1)
        return v if reference.ndim > 1 else v[:, 0]

    def viterbi_path(self, v: np.ndarray, reference: np.ndarray, query: np.ndarray, starts: np.ndarray | None = None) -> tuple[float, str]:
        """Log-likelihood and steps of the best path of one pair's table.

        Where the table holds no path: -100 for each base of both, and a path of least edit distance.
        """
        with np.errstate(divide="ignore"):
            t = np.log(self.t)
        i, k = len(query), len(reference)
        first = np.zeros(i + 1, np.int64) if starts is None else starts

        def at(i: int, k: int) -> np.ndarray:
            return v[:, i, k - first[i]] if i >= 0 and 0 <= k - first[i] < v.shape[-1] else np.full(3, -np.inf)

        state = int(at(i, k).argmax())
        score = float(at(i, k)[state])
        out: list[str] = []
        while i or k:
            if not np.isfinite(at(i, k)[state]):
                return -100.0 * (len(query) + len(reference)), distance_path(distance_table(reference, query), reference, query)
            if state == 0:
                out.append("=" if reference[k - 1] == query[i - 1] else "X")
                i, k = i - 1, k - 1
            elif state == 1:
                out.append("I")
                i -= 1
            else:
                out.append("D")
                k -= 1
            state = int((t[:, state] + at(i, k)).argmax())
        return score, "".join(reversed(out))

    def viterbi_paths(self, v: np.ndarray, references: np.ndarray, queries: np.ndarray, starts: np.ndarray, rows: np.ndarray, pads: np.ndarray) -> list[tuple[float, str]]:
        """`viterbi_path` of many pairs of one table at once; see `distance_paths`."""
        with np.errstate(divide="ignore"):
            t = np.log(self.t)
        many, (n, m), width = v.shape[1], (references.shape[-1], queries.shape[-1]), v.shape[-1]
        if many < FEW:
            return [self.viterbi_path(v[:, q, row:], references[q, pad:], queries[q, row:], starts[q, row:] - pad) for q, (row, pad) in enumerate(zip(rows.tolist(), pads.tolist(), strict=True))]
        steps, length, lost = np.zeros((many, n + m), np.uint8), np.zeros(many, np.int64), np.zeros(many, bool)
        letters = np.frombuffer(b"=ID", np.uint8)
        p, i, k = np.arange(many), np.full(many, m), np.full(many, n)

        def at(p: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
            c = k - starts[p, np.maximum(i, 0)]
            inside = (i >= rows[p]) & (c >= 0) & (c < width) & (k >= pads[p])
            return np.where(inside, v[:, p, np.maximum(i, 0), np.clip(c, 0, width - 1)], -np.inf)

        cells = at(p, i, k)
        state = cells.argmax(0)
        score = here = cells[state, p]
        while True:
            on = (i > rows[p]) | (k > pads[p])
            p, i, k, state, here = p[on], i[on], k[on], state[on], here[on]
            if not len(p):
                break
            fine = np.isfinite(here)
            lost[p[~fine]] = True
            p, i, k, state = p[fine], i[fine], k[fine], state[fine]
            taken = letters[state]
            if m and n:
                match = state == 0
                taken = np.where(match & (references[p, np.maximum(k - 1, 0)] != queries[p, np.maximum(i - 1, 0)]), ord("X"), taken)
            steps[p, length[p]] = taken
            length[p] += 1
            i, k = i - (state != 2), k - (state != 1)
            cells = t[:, state] + (own := at(p, i, k))
            state = cells.argmax(0)
            here = own[state, np.arange(len(p))]
        paths = _spelled(steps, length, lost)
        return [
            (float(s), path) if path is not None else self.viterbi_path(v[:, q, row:], references[q, pad:], queries[q, row:], starts[q, row:] - pad)
            for q, (s, path, row, pad) in enumerate(zip(score.tolist(), paths, rows.tolist(), pads.tolist(), strict=True))
        ]

    def viterbi(self, reference: np.ndarray, query: np.ndarray) -> tuple[float, str]:
        return self.viterbi_path(self.viterbi_table(reference, query), reference, query)

    def likelihoods(self, reference: np.ndarray, query: np.ndarray, band: Band | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood as it comes out of the forward table and out of the backward table."""
        x, y = _many(reference), _many(query)
        band = band or Band.full(len(x), x.shape[-1], y.shape[-1])
        (f, up), (b, down) = self._forward(x, y, band), self._backward(x, y, band)
        with np.errstate(divide="ignore"):
            ahead, behind = up[-1] + np.log(f[:, -1, -1].sum(0)), down[0] + np.log(b[0, 0, 0])
        return (ahead, behind) if reference.ndim > 1 else (ahead[0], behind[0])

    def expected(self, reference: np.ndarray, query: np.ndarray, band: Band | None = None) -> np.ndarray:
        """Each read's share in re-estimation, 9 + 16 + 16 numbers: each state's transitions, each reference base's and each
        previous base's emissions add up to 1; NaN where the likelihood isn't finite or differs backward."""
        x, y = _many(reference), _many(query)
        n, m, pairs = x.shape[-1], y.shape[-1], len(x)
        band = band or Band.full(pairs, n, m)
        f, up = self._forward(x, y, band)
        b, down = self._backward(x, y, band)
        insert, t, emit = self._insertions(y).T, self.t, self._emissions(self._after(x), y, band)
        before = np.full((n + 1, pairs), 9, np.uint8)
        before[1:] = x.T
        with np.errstate(divide="ignore", invalid="ignore"):
            ahead, behind = up[-1] + np.log(f[:, -1, -1].sum(0)), down[0] + np.log(b[0, 0, 0])
            bad = ~np.isfinite(ahead) | ~(np.abs(ahead - behind) <= AGREE)
            w_same, w_next = (np.exp(z - ahead) for z in (up + down, up[:-1] + down[1:]))
        moves, matches, after = np.zeros((pairs, 3, 3)), np.zeros((pairs, 4, 4)), np.zeros((pairs, 4, 4))
        every = np.arange(pairs)
        for i in range(m + 1):
            here = f[:, i] * w_same[i]
            steps = [(2, here, shifted(b[2, i], 1, 0.0))]
            if i < m:
                onward = f[:, i] * w_next[i]
                steps += [(s, onward, what) for s, what in enumerate(self._steps_from(b, emit, insert, band, i))]
            for to, come, go in steps:
                for s in range(3):
                    moves[:, s, to] += (come[s] * go).sum(0) * t[s, to]
            if i:
                met, own = here[0] * b[0, i], band.of(before, i)
                for base in range(4):
                    matches[every, base, y[:, i - 1]] += np.where(own == base, met, 0.0).sum(0)
                if i > 1:
                    after[every, y[:, i - 2], y[:, i - 1]] += (here[1] * b[1, i]).sum(0)
        share = lambda z: np.divide(z, z.sum(-1, keepdims=True), out=np.zeros_like(z), where=z.sum(-1, keepdims=True) > 0)
        out = np.concatenate([share(z).reshape(pairs, -1) for z in (moves, matches, after)], -1)
        out = np.where(bad[:, None] | (m == 0) | (n == 0), np.nan, out)
        return out if reference.ndim > 1 else out[0]


def _decayed_sum(x: np.ndarray, rate: float) -> np.ndarray:
    """y[k] = x[k] + rate * y[k - 1] along the columns of (columns, pairs), by doubling."""
    y, step, factor = x.copy(), 1, rate
    while step < len(y) and factor > 1e-300:
        y[step:] += factor * y[:-step]
        step, factor = 2 * step, factor * factor
    return y


def overlap_cut(tail: str, head: str) -> tuple[int, int]:
    """Where two neighbours change over, given the end of the left and the start of the right one: bases of `tail` to
    keep and of `head` to leave out.

    The two are aligned with free starts and a free end of `head` (match 1, anything else -1); the change is where half
    of `tail` is used up, or later, where the overlap starts.
    """
    n, m = len(tail), len(head)
    if not n or not m:
        return n, 0
    x, y = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (tail, head))
    k = np.arange(m + 1)
    best = np.zeros((n + 1, m + 1), np.int64)
    for i in range(1, n + 1):
        best[i, 1:] = np.maximum(best[i - 1, :-1] + 2 * (y == x[i - 1]) - 1, best[i - 1, 1:] - 1)
        best[i] = np.maximum.accumulate(best[i] + k) - k
    i, j = n, int(np.flatnonzero(best[n] == best[n].max())[-1])
    while i > n // 2 and j > 0:
        if best[i, j] == best[i - 1, j - 1] + (1 if x[i - 1] == y[j - 1] else -1):
            i, j = i - 1, j - 1
        elif best[i, j] == best[i, j - 1] - 1:
            j -= 1
        else:
            i -= 1
    return i, j
