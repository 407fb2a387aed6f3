"""The trie and its totals against recursion over lists, contraction against walking up every node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import contraction, conversation_trie as module
from strandloom.llm.contraction import subtree_totals
from strandloom.llm.conversation_trie import conversation_trie, prefix_sums
from strandloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth string, place string, conv string, `a.b c` string"


def expected(rows, share=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:] if share else turns
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below = [totals[k] for k in kids[node]]
        totals[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), *totals[n], sha(ends[n])) for n, m in members.items())


def run(spark, rows, share=True, parts=3):
    got = conversation_trie(spark.createDataFrame([(*r, *"kdpcx") for r in rows], SCHEMA).repartition(parts), share=share)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2])


def talks(seed, n=60, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        for t in range(rng.choice([1, 1, 2, 3, 8, 9, 14])):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice(["a", "bé", "c" * 200, ""][:words])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [True, False])
def test_against_recursion(spark, share):
    rows = talks(1)
    assert run(spark, rows, share) == expected(rows, share)


def test_odd_rows(spark):
    rows = talks(2, 30, 4) + [(None, 0, "user", "a"), (None, None, None, None), (700, None, None, None), (700, 0, "user", None), (700, 0, None, "x"), (705, 1, "user", "a"), (705, 1, "user", "a"), (706, -5, "", ""), (707, 3, "user", "long " * 20_000)]
    rows += [rows[0], rows[1]] + [(710, 2, "user", "same")] * 300
    assert run(spark, rows) == expected(rows)


def test_turnless(spark):
    """A conversation of few turns whose group has no first conversation may lose all of them."""
    rows = [(c, 0, "user", "a") for c in range(1, 200) if c % 5]
    assert run(spark, rows) == expected(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "a")]) == []


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(module, "PLAN_BITS", 6)
    monkeypatch.setattr(module, "PIECE_BYTES", 64)
    rows = [(5, t, "user", str(t % 7)) for t in range(3000)] + [(c, t, "user", "hi") for c in range(1000, 1400) for t in range(2)] + [(6, t, "user", str(t % 7)) for t in range(2500)]
    assert run(spark, rows, parts=7) == expected(rows)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_prefix_sums(spark, bits):
    rng = random.Random(bits)
    rows = [(k, p, rng.randrange(100)) for k, n in [(1, 40), (2, 1), (3, 7), (4, 8), (5, 65)] for p in range(n)]
    got = prefix_sums(spark.createDataFrame(rows, "k long, p long, v long"), "k", "p", ["v"], 64, bits).collect()
    assert {(r.k, r.p): r.v for r in got} == {(k, p): sum(v for a, b, v in rows if a == k and b <= p) for k, p, _ in rows}


def forest(kind, rng):
    n = 400
    if kind == "chain":
        return [None, *range(n - 1)]
    if kind == "star":
        return [None] + [0] * (n - 1)
    if kind == "comb":
        return [None] + [i - 1 if i % 2 else max(i - 2, 0) for i in range(1, n)]
    if kind == "forest":
        return [None if rng.random() < 0.02 else rng.randrange(max(0, i - 30), i) if i else None for i in range(n)]
    if kind == "missing":
        return [i - 1 if i % 100 else 10**6 + i for i in range(n)]
    return [None if i == 0 else (i - 1) // 2 for i in range(n)]


@pytest.mark.parametrize("kind", ["chain", "star", "comb", "forest", "missing", "binary"])
def test_contraction(spark, kind):
    rng = random.Random(3)
    parents, names = forest(kind, rng), rng.sample(range(10**7), 400)
    weight = [rng.randrange(50) if rng.random() < 0.9 else None for _ in parents]
    want = [0] * len(parents)
    for i, w in enumerate(weight):
        at = i
        while at is not None and at < len(parents):
            want[at] += w or 0
            at = parents[at]
    rows = [(names[i], None if p is None else names[p] if p < len(names) else -p, weight[i], 1) for i, p in enumerate(parents)]
    got = subtree_totals(spark.createDataFrame(rows, "id long, parent long, w long, one long"), ["w", "one"]).collect()
    assert sorted((r.id, r.w) for r in got) == sorted(zip(names, want, strict=True))


def test_circles_and_nothing(spark):
    for rows in ([(1, 2, 1), (2, 1, 1)], [(1, 1, 1)], [(1, 2, 1), (2, 1, 1), (3, 1, 1)]):
        with pytest.raises(ValueError):
            subtree_totals(spark.createDataFrame(rows, "id long, parent long, w long"), ["w"])
    assert subtree_totals(spark.createDataFrame([], "id long, parent long, w long"), ["w"]).collect() == []


def test_query_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_conversation_trie"](spark, folder).collect()), key=lambda r: r[:2]) == expected(rows)
