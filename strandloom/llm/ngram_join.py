"""N-gram Jaccard self-join with a token-group matrix, and the groups of linked documents.

1. Every document becomes its set of word shingles (64-bit hashes); equal sets are one node from here on.
2. Nodes are partitioned into families of similar documents.  A set of n shingles is cut by hash into more parts
   than a linked partner can differ in, so linked sets share at least one part whole (pigeonhole).  Shingles that very
   many sets hold are left out of the parts, which loses no link and keeps common passages from joining unrelated
   documents.  Nodes that share a part are joined as a star around the smallest of them, inside each batch first, so
   a part that very many documents share reaches the shuffle once a batch.  Batches send their keys packed by ranges, about 8
   bytes for a key and its node.  No link leaves a family.
   Large families are split once more: counts of shingles by hash range bound from below how much two sets
   differ, and what no bounded pair connects comes apart.
3. In a family the token-group matrix does the join: groups of similar documents, the union of each group's
   shingles, the overlap of every document with every union as bound, and only groups that can hold a partner are
   opened and compared exactly.  A family of more than a block is dealt as pairs of blocks to different tasks.  Every
   link is found once.  For groups, tasks emit the links that join something new and each node's number of linked
   documents, which grow with the nodes; only `jaccard_links` emits every link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, lean, materialise, mix, row_chunks, runs_of, text_buffer, whole_groups, words
from .components import connected_components

BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_500_000
#: Families beyond either are split by the bound on sketches before their texts are compared.
LARGE_ROWS = 48
LARGE_SHINGLES = 200_000
GROUP_ROWS = 16
#: Ids of documents to fetch are broadcast up to this many, else joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Before that shuffle documents are told by a slot of their id, one of so many: the slots in use are broadcast, whatever the table's size.
SLOTS = 1 << 22
#: Shingles found in this many sets count as frequent; of more than FREQUENT_LIMIT of them the most frequent do.  They
#: only steer which parts are compared: results are the same with any list.
FREQUENT = 32
FREQUENT_LIMIT = 1_000_000
#: Rows of keys, or shingles, that a task holds before it passes them on.
_HOLD = 2_000_000
#: Keys of parts are dealt by ranges: about so many keys at most in each, and so many ranges to a task.
RANGE_KEYS, RANGES = 1_000_000, 8
_U = np.uint64
_B = _U(0x9DDFEA08EB382D69)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows and the offsets of the rows among them.

    A-Z count as a-z.  A row of fewer than k words has one shingle, its whole sequence; a row without words none.
    """
    found: list[np.ndarray] = []
    sizes = [np.zeros(1, np.int64)]
    for i, j in row_chunks(offsets):
        own = offsets[i : j + 1] - offsets[i]
        _, _, row, h = words(LOWER[data[offsets[i] : offsets[j]]], own)
        n_words = np.bincount(row, minlength=j - i)
        first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        n_windows = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        at = np.repeat(first - np.cumsum(n_windows) + n_windows, n_windows) + np.arange(n_windows.sum())
        reach = np.minimum(np.repeat(n_words, n_windows), k)
        code = reach.astype(np.uint64)
        for step in range(k):
            here = step < reach
            code[here] = code[here] * _B + h[at[here] + step]
        code = mix(code)
        ends = np.cumsum(n_windows)
        for a, b in zip((ends - n_windows).tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                code[a:b].sort()
        keep = np.ones(len(code), bool)
        keep[1:] = code[1:] != code[:-1]
        keep[(ends - n_windows)[n_windows > 0]] = True
        found.append(code[keep])
        kept = np.concatenate([[0], np.cumsum(keep)])
        sizes.append(kept[ends] - kept[ends - n_windows])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(np.concatenate(sizes))


def set_ids(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One even, non-zero number for each set (0 for an empty one), the same for equal sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)])
    size = np.diff(offsets).astype(np.uint64)
    ids = mix(sums[offsets[1:]] - sums[offsets[:-1]] + size * _B) & ~_U(1)
    return np.where(size > 0, np.maximum(ids, _U(2)), _U(0)).view(np.int64)


@cache
def _levels(percent: int, largest: int) -> tuple[tuple[int, int, int, int], ...]:
    """(smallest size, largest size, parts, how many elements linked sets can differ in) of each level.

    Any two linked sets meet in a level: both in one size class, or on the two sides of a border between classes.
    """
    bad, all_ = 100 - percent, 100 + percent
    levels = []
    low, high = 1, 1
    while low <= largest:
        for least, most, differ in (
            (low, high, 2 * high * bad // all_),
            (-(-(high + 1) * percent // 100), high * 100 // percent, (high + high * 100 // percent) * bad // all_),
        ):
            slack = int(2.2 * differ * np.exp(-least / (differ + 1)))
            if least <= most:
                levels.append((least, most, differ + 1 + slack, differ))
        low, high = high + 1, 2 * high
    return tuple(levels)


#: Ways to cut a set, tried in turn: whether frequent shingles are left out, and parts for each possible difference
#: (0: the level's own number).  The last ones cut the whole set by other hashes.
_CUTS = ((True, 0), (True, 2), (True, 4), (False, 0), (False, 0), (False, 0), (False, 0), (False, 0), (False, 0))


def part_keys(code: np.ndarray, offsets: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, odd keys): sets linked at `percent` share at least one key.

    Parts are ranges of the hash, so a part of a sorted set is a slice.  Linked sets differ in at most d elements,
    so at most d parts differ, and a set with more than d parts that aren't empty shares one of those with any
    partner.  A set with fewer is cut again in the next way; two partners that both are meet there.  Only in the last
    way do empty parts make keys.  Leaving elements out makes no difference larger, so `frequent` shingles (a
    sorted array, the same for all sets) are left out first: parts that many texts share would join unrelated sets.
    """
    sizes = np.diff(offsets)
    rows_out, keys_out = [], []
    if not len(sizes) or not sizes.max():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = (code, offsets, sizes)
    rare = whole
    if frequent is not None and len(frequent):
        keep = frequent[np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)] != code
        at = np.concatenate([[0], np.cumsum(keep)])[offsets]
        rare = (code[keep], at, np.diff(at))
    for level, (least, most, own_parts, differ) in enumerate(_levels(percent, int(sizes.max()))):
        rows = np.flatnonzero((sizes >= least) & (sizes <= most))
        for cut, (sparse, multiple) in enumerate(_CUTS):
            if not len(rows):
                break
            if sparse and rare is whole:
                continue
            elements, starts_at, counts = rare if sparse else whole
            parts = multiple * (differ + 1) or own_parts
            n = counts[rows]
            at = np.repeat(starts_at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            member = elements[at]
            local = np.repeat(np.arange(len(rows)), n)
            where = member if sparse or cut == 3 else mix(member + _U(cut * int(_B) % (1 << 64)))
            part = ((where >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            slot = local * parts + part
            if where is not member:
                order = np.argsort(slot, kind="stable")
                slot, member = slot[order], member[order]
            starts = runs_of(slot)[:-1]
            sums = np.add.reduceat(mix(member + _B), starts) if len(slot) else np.zeros(0, np.uint64)
            slot = slot[starts] if len(slot) else slot
            full = np.bincount(slot // parts, minlength=len(rows))
            weak = full <= differ
            if cut == len(_CUTS) - 1 and weak.any():
                every = np.zeros(len(rows) * parts, bool)
                every[slot] = True
                empty = np.flatnonzero(~every & np.repeat(weak, parts))
                slot, sums = np.concatenate([slot, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
            place = (slot % parts).astype(np.uint64) + _U((level * 64 + cut) << 40)
            keys_out.append(mix(mix(sums + _U(7)) + place * _B) | _U(1))
            rows_out.append(rows[slot // parts])
            rows = rows[weak]
    return np.concatenate(rows_out), np.concatenate(keys_out)


def _star_rows(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one batch: (key, centre) to look for elsewhere, and the star's (centre, node) edges inside the batch."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    starts = runs_of(keys)
    centre = np.repeat(nodes[starts[:-1]], np.diff(starts))
    apart = nodes != centre
    edges = np.unique(np.stack([centre[apart], nodes[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return keys[starts[:-1]], nodes[starts[:-1]], edges[:, 0], edges[:, 1]


def _packed(keys: np.ndarray, names: np.ndarray, ranges: int, bits: int, width: int) -> tuple[list[int], list[int], list[bytes]]:
    """Sorted keys and the name of each as one row for each range of the keys: its number, its first key, and the rest.

    Of a key `bits` bits are kept, as the difference from the one before in as many bytes as the range needs; of a name `width` bytes.
    """
    if not len(keys):
        return [], [], []
    code = keys >> _U(64 - bits)
    part = ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    starts = runs_of(part)
    step = np.zeros(len(code), np.uint64)
    step[1:] = code[1:] - code[:-1]
    step[starts[:-1]] = 0
    most = np.maximum.reduceat(step, starts[:-1]).tolist()
    steps, own = step.view(np.uint8).reshape(-1, 8), names.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width]
    blobs = []
    for lo, hi, top in zip(starts[:-1].tolist(), starts[1:].tolist(), most, strict=True):
        bytes_ = max(1, (top.bit_length() + 7) // 8)
        blobs.append(bytes([bytes_]) + steps[lo:hi, :bytes_].tobytes() + own[lo:hi].tobytes())
    return part[starts[:-1]].tolist(), code[starts[:-1]].astype(np.int64).tolist(), blobs


def _unpacked(first: int, blob: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, names) of a row of `_packed`."""
    bytes_ = int(blob[0])
    n = (len(blob) - 1) // (bytes_ + width)
    step, name = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    step[:, :bytes_] = blob[1 : 1 + n * bytes_].reshape(n, bytes_)
    name[:, :width] = blob[1 + n * bytes_ :].reshape(n, width)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64) + _U(first), name.view(np.int64).ravel()


def _names(nodes: np.ndarray, width: int) -> np.ndarray:
    """The first `width` bytes of nodes, as numbers."""
    return (nodes.view(np.uint64) >> _U(64 - 8 * width)).view(np.int64)


def _emit_parts(k: int, percent: int, frequent: Broadcast, ranges: int, bits: int, width: int):
    """Rows (part, a, b, packed): of each batch its keys, packed by ranges, or without `packed` an edge between two names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(frequent.value, np.uint64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            keys, nodes, held = [], [], 0
            seen = np.zeros(0, np.int64)
            for i, j in row_chunks(offsets):
                code, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                ids = set_ids(code, at)
                _, first = np.unique(ids, return_index=True)  # copies inside the batch count once
                fresh = first[(ids[first] != 0) & ~np.isin(ids[first], seen)]
                seen = np.concatenate([seen, ids[fresh]])
                wanted = np.zeros(len(ids), bool)
                wanted[fresh] = True
                code = code[np.repeat(wanted, np.diff(at))]
                at = np.concatenate([[0], np.cumsum(np.diff(at)[wanted])])
                row, key = part_keys(code, at, percent, common)
                keys.append(key)
                nodes.append(_names(ids[wanted], width)[row])
                held += len(key)
                if held > _HOLD or j == len(offsets) - 1:
                    key, centre, a, b = _star_rows(np.concatenate(keys), np.concatenate(nodes))
                    keys, nodes, held = [], [], 0
                    part, first_key, blobs = _packed(key, centre, ranges, bits, width)
                    columns = [np.concatenate([np.array(part, np.int64), a % ranges]), np.concatenate([np.array(first_key, np.int64), a]), np.concatenate([np.zeros(len(part), np.int64), b])]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array([*blobs, *[None] * len(a)], pa.binary())], names=["part", "a", "b", "packed"])

    return lean(run)


def _stars(width: int):
    """Edges (a, b) of names from the rows of `_emit_parts`, sorted by part: of each key a star around its smallest name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["part"]):
            table = table.combine_chunks()
            part, a, b = (table.column(c).to_numpy() for c in ("part", "a", "b"))
            data, offsets = text_buffer(table.column("packed"))
            known = np.diff(offsets) > 0
            edges = [np.stack([a[~known], b[~known]], 1)]
            starts = runs_of(part)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                rows = [_unpacked(int(a[r]), data[offsets[r] : offsets[r + 1]], width) for r in range(lo, hi) if known[r]]
                if len(rows) > 1:
                    _, _, centre, name = _star_rows(np.concatenate([key for key, _ in rows]), np.concatenate([name for _, name in rows]))
                    edges.append(np.stack([centre, name], 1))
            found = np.unique(np.concatenate(edges), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return lean(run)


def _families(parts_of: Callable[[int, int, int], DataFrame], firsts: DataFrame, n_sets: int, n_shingles: int, percent: int) -> DataFrame:
    """(node, family) of the nodes that share a part with another one.

    What is shuffled of a key and its node are short forms: half of a node's bytes are its name, and of a key so many bits are kept
    that chance hardly joins keys.  Nodes of one name are in one family, so short forms can join families but lose no link.
    """
    spark = firsts.sparkSession
    n_keys = 4 * n_sets + int(n_shingles * 3 * (100 - percent) / (100 + percent)) + 1
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // (RANGES * RANGE_KEYS)))
    width = 4 if n_sets < 1 << 25 else 5
    bits = min(63, max(48, int(np.ceil(2 * np.log2(n_keys) - np.log2(n_sets + 1) + 9))))
    parts = parts_of(RANGES * tasks, bits, width)
    dealt = parts.repartition("part") if tasks == int(spark.conf.get("spark.sql.shuffle.partitions")) else parts.repartition(tasks, "part")
    stars = dealt.sortWithinPartitions("part").mapInArrow(_stars(width), "a long, b long").distinct()
    linked = materialise(connected_components(stars).select(F.col("node").alias("name"), F.col("component").alias("family")))
    named = firsts.select("node", F.shiftrightunsigned("node", 64 - 8 * width).alias("name"))
    shared = named.groupBy("name").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1").join(linked, "name", "left_anti")
    return named.join(linked.unionByName(shared.select("name", F.col("name").alias("family"))), "name").select("node", "family")


def link_family(sets: list[np.ndarray], sides: np.ndarray, cross: bool, percent: int) -> np.ndarray:
    """All links among `sets` (sorted distinct hashes) as rows of two indices, by a token-group matrix.

    With `cross` only pairs with different `sides` are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = 0 if cross and sides[0] == sides[1] else len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([(0, 1)] if common and 100 * common >= percent * (sizes.sum() - common) else [], np.int64).reshape(-1, 2)
    order = np.array(sorted(range(n), key=lambda i: (int(sets[i][0]), i)))  # neighbours in min-hash order are alike
    sets, sizes, sides = [sets[i] for i in order], sizes[order], sides[order]
    group = np.arange(n) // GROUP_ROWS
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    n_groups = int(group[-1]) + 1
    cells = np.unique(column * n_groups + np.repeat(group, sizes))  # of the token-group matrix
    in_groups = np.bincount(cells // n_groups, minlength=len(tokens))
    shared = np.cumsum(in_groups > 1) - 1  # a token of one group says nothing about the others: it needs no row
    matrix = np.zeros((int(shared[-1]) + 1, n_groups), bool)
    cells = cells[in_groups[cells // n_groups] > 1]
    matrix[shared[cells // n_groups], cells % n_groups] = True
    mark = np.zeros(len(tokens), bool)
    links = [np.zeros((0, 2), np.int64)]
    for q in range(n):
        own = column[at[q] : at[q + 1]]
        bound = matrix[shared[own[in_groups[own] > 1]]].sum(0)
        bound[group[q]] = sizes[q]
        mark[own] = True
        for g in np.flatnonzero(100 * bound >= percent * sizes[q]):
            lo, hi = max(q + 1, g * GROUP_ROWS), min(n, (g + 1) * GROUP_ROWS)
            if lo >= hi:
                continue
            fits = 100 * np.minimum(sizes[lo:hi], sizes[q]) >= percent * np.maximum(sizes[lo:hi], sizes[q])
            if cross:
                fits &= sides[lo:hi] != sides[q]
            if not fits.any():
                continue
            common = np.add.reduceat(mark[column[at[lo] : at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)
            linked = np.flatnonzero(fits & (100 * common >= percent * (sizes[q] + sizes[lo:hi] - common))) + lo
            links.append(np.stack([np.full(len(linked), order[q]), order[linked]], 1))
        mark[own] = False
    return np.concatenate(links)


def spanning_links(links: np.ndarray, n: int) -> np.ndarray:
    """As few of the links between n nodes as connect what they connect."""
    root = np.arange(n)
    kept = []
    for start, end in zip((at := runs_of(links[:, 0]))[:-1].tolist(), at[1:].tolist(), strict=True):
        q = links[start, 0]
        others = links[start:end, 1]
        roots, first = np.unique(root[others], return_index=True)
        fresh = roots != root[q]
        if fresh.any():
            kept.append(start + first[fresh])
            root[np.isin(root, roots[fresh])] = root[q]
    return links[np.concatenate(kept)] if kept else links[:0]


def _link_families(k: int, percent: int, every: bool):
    """Rows (a, b, n): links have no n; a node's number of linked documents in the task has no b.

    Links are `every` one, or as few as connect what is connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["family", "i", "j"]):
            table = table.combine_chunks()
            data, offsets = text_buffer(table.column("text"))
            family, i, j, side, wanted, docs = (table.column(c).to_numpy() for c in ("family", "i", "j", "side", "node", "docs"))
            starts = runs_of(np.stack([family, i, j], 1).view("i8,i8,i8").ravel())
            out = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                code, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                ids = set_ids(code, at)
                # A repeated id may have brought other texts along; each node stands once on its side.
                _, first = np.unique(ids, return_index=True)
                rows = np.array([r for r in first.tolist() if ids[r] == wanted[lo + r]], np.int64)
                if len(rows) > 1:
                    links = link_family([code[at[r] : at[r + 1]] for r in rows], side[lo:hi][rows], bool(i[lo] != j[lo]), percent)
                    if not len(links):
                        continue
                    node, n_docs = ids[rows], docs[lo:hi][rows]
                    n_links = np.zeros(len(rows), np.int64)
                    np.add.at(n_links, links[:, 0], n_docs[links[:, 1]])
                    np.add.at(n_links, links[:, 1], n_docs[links[:, 0]])
                    shown = node[links if every else spanning_links(links, len(rows))]
                    some = np.flatnonzero(n_links)
                    out.append(pa.RecordBatch.from_arrays([pa.array(shown[:, 0]), pa.array(shown[:, 1]), pa.nulls(len(shown), pa.int64())], names=["a", "b", "n"]))
                    out.append(pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(n_links[some])], names=["a", "b", "n"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return lean(run)


def _count_shingles(k: int):
    """Rows (doc_id, node, n_shingles), and of each batch rows (token, sets) for shingles in two or more of its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            node, size, codes, held = [], [], [], 0
            seen = np.zeros(0, np.int64)
            for i, j in row_chunks(offsets):
                code, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                ids = set_ids(code, at)
                _, first = np.unique(ids, return_index=True)
                fresh = np.zeros(len(ids), bool)
                fresh[first[~np.isin(ids[first], seen)]] = True
                seen = np.concatenate([seen, ids[fresh]])
                codes.append(code[np.repeat(fresh, np.diff(at))])
                held += len(codes[-1])
                node.append(ids)
                size.append(np.diff(at))
                if held > _HOLD or j == len(offsets) - 1:
                    tokens = np.sort(np.concatenate(codes))
                    starts = runs_of(tokens)
                    many = np.diff(starts) > 1
                    m = int(many.sum())
                    columns = [pa.nulls(m, pa.int64())] * 3 + [pa.array(tokens[starts[:-1][many]].view(np.int64)), pa.array(np.diff(starts)[many])]
                    codes, held = [], 0
                    yield pa.RecordBatch.from_arrays(columns, names=_COUNTED)
            if not node:
                continue
            ids, sizes = np.concatenate(node), np.concatenate(size)
            columns = [batch.column(0), pa.array(ids, mask=ids == 0), pa.array(sizes), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=_COUNTED)

    return lean(run)


_COUNTED = ["doc_id", "node", "n_shingles", "token", "sets"]


def _count_sketches(k: int):
    """Of each fetched member: how many of its shingles fall in each range of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            buckets, wanted = batch.column("buckets").to_pylist(), batch.column("node").to_numpy()
            keep, sketches = [], []
            for i, j in row_chunks(offsets):
                code, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                ids = set_ids(code, at)
                for r in range(i, j):
                    if ids[r - i] == wanted[r]:
                        place = (code[at[r - i] : at[r - i + 1]] >> _U(32)) * _U(buckets[r]) >> _U(32)
                        keep.append(r)
                        sketches.append(np.minimum(np.bincount(place.astype(np.int64), minlength=buckets[r]), 255).astype(np.uint8).tobytes())
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("family", "side", "blocks", "node", "n")), pa.array(sketches, pa.binary())], names=_SKETCHED)

    return lean(run)


_SKETCHED = ["family", "side", "blocks", "node", "n", "sketch"]


def _bound_families(percent: int):
    """Links between members whose sketches don't rule a link out, as few as connect them.

    Two sets differ in at least as many elements as their counts differ in, summed over the ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["family", "i", "j"]):
            table = table.combine_chunks()
            data, offsets = text_buffer(table.column("sketch"))
            family, i, j, side, node, size = (table.column(c).to_numpy() for c in ("family", "i", "j", "side", "node", "n"))
            starts = runs_of(np.stack([family, i, j], 1).view("i8,i8,i8").ravel())
            a_out, b_out = [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                counts = data[offsets[lo] : offsets[hi]].reshape(hi - lo, -1).astype(np.int16)
                root = np.arange(hi - lo)
                for q in range(hi - lo):
                    others = np.flatnonzero(root[q + 1 :] != root[q]) + q + 1
                    if i[lo] != j[lo]:
                        others = others[side[lo + others] != side[lo + q]]
                    both = size[lo + others] + size[lo + q]
                    others = others[np.abs(size[lo + others] - size[lo + q]) * (100 + percent) <= both * (100 - percent)]
                    if not len(others):
                        continue
                    both = size[lo + others] + size[lo + q]
                    apart = np.abs(counts[others] - counts[q]).sum(1, dtype=np.int64)
                    for m in others[apart * (100 + percent) <= both * (100 - percent)].tolist():
                        if root[m] != root[q]:
                            a_out.append(node[lo + q])
                            b_out.append(node[lo + m])
                            root[root == root[m]] = root[q]
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return lean(run)


def _paired_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of families dealt by pairs of blocks (i, j), sorted by them: a row goes to each pair its block is in."""
    tasks = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    tasks = tasks.select("family", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", *columns)
    return tasks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")


def _beside(rows: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join a table of one row a key, by broadcast while it has at most BROADCAST_ROWS rows, so that no key gathers its rows."""
    table = materialise(table)
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, on, how)


def _likely(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose id has a slot that an id of `rows` has: all of theirs and few others, so that a join shuffles few texts."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    slots = materialise(rows.select(slot.alias("slot")).distinct())
    return docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").select(*docs.columns)


def _compare(df: DataFrame, k: int, percent: int, id_col: str, text_col: str, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, node, n_shingles) of each row; of each node its smallest doc_id, size, copies and documents; what the
    tasks of `_link_families` found."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = materialise(docs.mapInArrow(_count_shingles(k), ", ".join(f"{c} long" for c in _COUNTED)))
    tokens = counted.filter("token is not null").groupBy("token").agg(F.sum("sets").alias("sets")).filter(F.col("sets") >= FREQUENT)
    common = np.array([r["token"] for r in tokens.orderBy(F.desc("sets"), "token").limit(FREQUENT_LIMIT).select("token").collect()], np.int64)
    frequent = df.sparkSession.sparkContext.broadcast(np.sort(common.view(np.uint64)).tobytes())
    counted = counted.filter("n_shingles is not null").select("doc_id", "node", "n_shingles")
    firsts = counted.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.countDistinct("doc_id").alias("docs"))
    firsts = materialise(firsts.filter("doc_id is not null"))
    sizes = counted.agg(F.count("node"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    parts_of = lambda ranges, bits, width: docs.select("text").mapInArrow(_emit_parts(k, percent, frequent, ranges, bits, width), "part long, a long, b long, packed binary")
    families = _families(parts_of, firsts, *sizes, percent)
    members = materialise(families.join(firsts.drop("copies"), "node"))

    def in_blocks(rows: DataFrame, shingles: int) -> DataFrame:
        size = rows.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / shingles)).cast("int").alias("blocks"), F.avg("n").alias("mean"))
        size = size.withColumn("buckets", F.pow(F.lit(2), F.greatest(F.lit(6), F.least(F.lit(12), F.round(F.log2(F.col("mean") / 2.5))))).cast("int")).drop("mean")
        return materialise(_beside(rows, size, "family").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")))

    def with_text(rows: DataFrame) -> DataFrame:
        if rows.count() <= BROADCAST_ROWS:
            return docs.join(F.broadcast(rows), "doc_id")
        return _likely(docs, rows).join(rows, "doc_id")

    # Large families are split first by a bound that needs a small sketch of each text instead of the text.
    large = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).filter((F.col("rows") > LARGE_ROWS) | (F.col("total") > LARGE_SHINGLES)).select("family")
    large = materialise(large)
    sketched = with_text(in_blocks(_beside(members, large, "family", "left_semi"), 1 << 62)).mapInArrow(_count_sketches(k), "family long, side long, blocks int, node long, n long, sketch binary")
    bound = connected_components(_paired_blocks(sketched, ["node", "n", "sketch"]).mapInArrow(_bound_families(percent), "a long, b long"))
    split = members.drop("family").join(bound.withColumnRenamed("component", "family"), "node").select(*members.columns)
    members = in_blocks(_beside(members, large, "family", "left_anti").unionByName(split), BLOCK_SHINGLES)
    tasks = _paired_blocks(with_text(members), ["node", "docs", "text"])
    return counted, firsts, materialise(tasks.mapInArrow(_link_families(k, percent, every), "a long, b long, n long"))


def jaccard_components(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, n_shingles, component_id, n_links.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of k-word shingles; component_id is
    the smallest doc_id that links reach and n_links the number of other documents that the row's text links with, copies
    included.  A text of fewer than k words is one shingle; a null text or one without
    words has an empty set, links with nothing and is its own component.  Rows with one id count as one document
    where their texts are equal and are joined by that text's links where they differ.  A row with a null id is
    labelled like the documents with its set, else null.  Empty tables give empty results; other columns are ignored.
    """
    counted, firsts, found = _compare(df, k, percent, id_col, text_col)
    links = connected_components(found.filter("b is not null").select("a", "b"))
    partners = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("partners"))

    linked = links.join(firsts, "node").select("node", "component", "doc_id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = firsts.join(linked.join(least, "component").select("node", "component_id"), "node", "left").filter("copies > 1 OR component_id IS NOT NULL").join(partners, "node", "left")
    labels = labels.select("node", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("docs") + F.coalesce("partners", F.lit(0))).alias("reached"))
    labelled = _beside(counted, labels, "node", "left")
    n_links = F.coalesce(F.col("reached") - F.col("doc_id").isNotNull().cast("long"), F.lit(0)).alias("n_links")
    return labelled.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), n_links)


def jaccard_links(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link of `jaccard_components` between different sets as (a, b), a < b: each set stands by its smallest doc_id.

    The links of n alike texts are n (n - 1) / 2 rows.
    """
    _, firsts, found = _compare(df, k, percent, id_col, text_col, every=True)
    ends = [firsts.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_id")) for c in ("a", "b")]
    links = found.filter("b is not null").select("a", "b").join(ends[0], "a").join(ends[1], "b")
    return links.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
