"""Exact dedup, substring dedup and the n-gram join against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from strandloom.llm.components import connected_components
from strandloom.llm.exact_dedup import content_sort_dedup
from strandloom.llm.ngram_join import _families, _likely, _packed, _unpacked, jaccard_components, jaccard_links, part_keys
from strandloom.llm.substring_dedup import remove_repeats

from . import cases

SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in SPACES:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out + [now] * bool(now)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(parts)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = cases.awkward() + cases.rows(["Same text"] * 300, range(1000, 1300))
    got = content_sort_dedup(table(spark, rows, 7), keep=keep).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    for text, ids in groups.items():
        own = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        real = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(real) if real else None
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own)
        assert {r.group_size for r in own} == {len(ids)} and {r.keep_id for r in own} == {best}
        assert [r.doc_id for r in own if r.kept] == [best]


def test_exact_dedup_empty(spark):
    assert content_sort_dedup(table(spark, [])).collect() == []


def brute_components(rows, k, percent):
    def shingles(text):
        w = words(lower(text))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    docs = [(r[0], shingles(r[1])) for r in rows]
    nodes = sorted({s for _, s in docs if s}, key=lambda s: sorted(s))
    root = {s: s for s in nodes}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for i, s in docs:
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    # sets that only null ids have aren't fetched and join nothing; the fixtures hold no such set with a partner
    return sorted(((str(i), len(s), str(least.get(find(s)) if s else i)) for i, s in docs))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 70)])
def test_ngram_join(spark, k, percent, monkeypatch):
    monkeypatch.setattr("strandloom.llm.ngram_join.FREQUENT", 20)
    monkeypatch.setattr("strandloom.llm.ngram_join.LARGE_ROWS", 5)
    rng = random.Random(k)
    rows = cases.awkward(k)
    base = [f"b{rng.randrange(60)}" for _ in range(90)]
    for i in range(700):  # a large group of near copies, of all degrees, more than one block
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9, 14])):
            w[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        rows += cases.rows([" ".join(w[: rng.choice([90, 90, 88, 80])])], [5000 + i])
    got = jaccard_components(table(spark, rows), k, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, k, percent)


def test_ngram_join_links(spark, monkeypatch):
    """Every link is found, in families of one block and of several, and each document's number of links counts copies."""
    monkeypatch.setattr("strandloom.llm.ngram_join.BLOCK_ROWS", 40)
    monkeypatch.setattr("strandloom.llm.ngram_join.LARGE_ROWS", 5)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["one two three four", "one two three four", "alone here", None, ""]
    docs = table(spark, cases.rows(texts))
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w := words(t)) >= 3 else frozenset([tuple(w)] if w else []) for t in texts]
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and 100 * len(a & b) >= 80 * len(a | b)}
    got = {r.doc_id: r.n_links for r in jaccard_components(docs, 3, 80).collect()}
    assert got == {i: sum(i in pair for pair in linked) for i in range(len(texts))} and max(got.values()) > 40
    first = [sets.index(s) for s in sets]
    assert sorted((r.a, r.b) for r in jaccard_links(docs, 3, 80).collect()) == sorted(p for p in linked if first[p[0]] == p[0] and first[p[1]] == p[1] and sets[p[0]] != sets[p[1]])


def test_ngram_join_empty(spark):
    assert jaccard_components(table(spark, [])).collect() == []
    assert [r.component_id for r in jaccard_components(table(spark, cases.rows([None, "", " "]))).orderBy("doc_id").collect()] == [0, 1, 2]


def test_linked_sets_share_a_part():
    import numpy as np

    rng = random.Random(5)
    for trial in range(3000):
        percent = rng.choice([70, 80, 90])
        a = {rng.getrandbits(63) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 17, 33, 64, 65, 129, 300]))}
        b = set(a)
        for _ in range(rng.randint(0, len(a) // 5 + 1)):
            if rng.random() < 0.5 and len(b) > 1:
                b.pop()
            else:
                b.add(rng.getrandbits(63))
        if 100 * len(a & b) < percent * len(a | b):
            continue
        code = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (a, b)])
        common = np.sort(np.array([x for x in a | b if rng.random() < trial % 5 / 4] or [1], np.uint64))
        row, key = part_keys(code, np.array([0, len(a), len(a) + len(b)]), percent, common)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist()), trial


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(-50, 300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert connected_components(spark.createDataFrame([], "x long, y long")).collect() == []


def brute_repeats(rows, window):
    texts = defaultdict(set)
    for r in rows:
        texts[2**63 - 1 if r[0] is None else r[0]].add(r[1] or "")
    place = {(i, t): n for i, own in texts.items() for n, t in enumerate(sorted(own, key=lambda t: t.encode()))}
    first = {}
    for i, t in sorted(place, key=lambda x: (x[0], place[x])):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, t, p))
    out = []
    for r in rows:
        i, t = 2**63 - 1 if r[0] is None else r[0], r[1] or ""
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, t, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(r[0]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("window", [20, 7])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    rows = cases.awkward(window)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(60))
    rows += cases.rows([" ".join(f"u{rng.randrange(999)}" for _ in range(rng.randrange(50))) + " " + passage + " tail " + passage[: rng.randrange(200)] for _ in range(200)], range(900, 1100))
    rows += cases.rows(["a b " * 40, "a " * 100, "a " * 19, "a " * 20], range(2000, 2004))
    got = remove_repeats(table(spark, rows, 5), window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute_repeats(rows, window)


def test_substring_dedup_empty(spark):
    assert remove_repeats(table(spark, [])).collect() == []


def test_substring_dedup_levels_and_null_ids(spark):
    from strandloom.llm.substring_dedup import _levels

    assert _levels(20) == [5, 10, 20] and _levels(50) == [6, 12, 25, 50] and _levels(160) == [5, 10, 20, 40, 80, 160] and _levels(9) == [9]
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [f"{' '.join(f'{name}{k}' for k in range(6))} {passage} {name}z" for name in "abcdefgh"]
    rows = cases.rows([*texts, texts[0], passage], [None] * 8 + [None, 2**40])
    got = remove_repeats(table(spark, rows, 4)).collect()
    removed = sorted(r.n_removed for r in got if r.doc_id is None)
    assert removed == [30] * 9 and [r.n_removed for r in got if r.doc_id is not None] == [0]
    got = remove_repeats(table(spark, rows[:-1], 4)).collect()  # without a named one, one text (twice, if it is the repeated row) keeps it
    assert sorted(r.n_removed for r in got) in ([0] + [30] * 8, [0, 0] + [30] * 7)
    with pytest.raises(Exception, match="id too large"):
        remove_repeats(table(spark, cases.rows(["a b"], [2**63 - 1]))).collect()


def test_keys_of_parts_are_shuffled_in_few_bytes():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(1, 2**64, 1_000_000, dtype=np.uint64))
    names = rng.integers(0, 2**32, len(keys))
    part, first, blobs = _packed(keys, names, 400, 48, 4)
    assert part == list(range(400)) and sum(map(len, blobs)) < 9.5 * len(keys)
    found = [_unpacked(f, np.frombuffer(b, np.uint8), 4) for f, b in zip(first, blobs, strict=True)]
    assert (np.concatenate([k for k, _ in found]) == keys >> np.uint64(16)).all()
    assert (np.concatenate([n for _, n in found]) == names).all()


def test_nodes_of_one_name_are_a_family(spark):
    nodes = [((1 << 40) + 2, 1), ((1 << 40) + 4, 2), ((9 << 40) + 2, 3), (-(1 << 40), 4)]
    firsts = spark.createDataFrame(nodes, "node long, doc_id long")
    none = lambda *_: spark.createDataFrame([], "part long, a long, b long, packed binary")
    assert {r["node"] for r in _families(none, firsts, 4, 100, 80).collect()} == {(1 << 40) + 2, (1 << 40) + 4}
    edge = lambda *_: spark.createDataFrame([(0, 9 << 8, (1 << 32) - (1 << 8), None)], "part long, a long, b long, packed binary")
    assert {r["node"]: r["family"] for r in _families(edge, firsts, 4, 100, 80).collect() if r["node"] in (nodes[2][0], nodes[3][0])} == {nodes[2][0]: 9 << 8, nodes[3][0]: 9 << 8}


def test_a_join_by_shuffle_is_of_few_texts(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    kept = {r["doc_id"] for r in _likely(docs, docs.filter("doc_id % 50 = 0").select("doc_id")).collect()}
    assert set(range(0, 10_000, 50)) <= kept and len(kept) < 250
