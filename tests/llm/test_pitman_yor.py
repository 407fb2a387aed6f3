"""The Pitman-Yor model: distributions, a brute-force sampler, and the same answers however the work is cut."""

import math
import random
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import pitman_yor as py

from . import cases
from .test_dedup import table

TRAINING = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10]
HELD_OUT = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 10 == 0]


def corpus(rng, n_texts, n_words, length):
    """Texts from a chain in which each word has a few usual successors."""
    vocabulary = [f"w{i}" for i in range(n_words)]
    after = {w: rng.choices(vocabulary, k=3) for w in vocabulary}
    texts = []
    for _ in range(n_texts):
        text = [rng.choice(vocabulary)]
        while len(text) < length:
            text.append(rng.choice(after[text[-1]]) if rng.random() < 0.8 else rng.choices(vocabulary, [1 / (i + 1) for i in range(n_words)])[0])
        texts.append(" ".join(text))
    return texts


def test_predictions_add_up(spark):
    """P(w after u) isn't returned, but scores of texts of one and two words give it up to x[w] = P(w at the start).  That
    every context's probabilities add up to 1 is then a linear system for x, and the start's own sum is left to check."""
    train = corpus(random.Random(4), 30, 12, 25)
    seen = sorted({w for t in train for w in t.split()})
    known = [*seen, "unknown"]
    probes = ["", *known, *(f"{u} {w}" for u in known for w in known)]
    rows = cases.rows(train, TRAINING[:30]) + cases.rows(probes, HELD_OUT[: len(probes)])
    model = py.Model()
    by_id = {r.doc_id: r.score for r in py.score_texts(table(spark, rows), n_sweeps=3, model=model).collect()}
    score = {t: by_id[i] for t, i in zip(probes, HELD_OUT, strict=False)}
    ratio = np.array([[10 ** (score[f"{u} {w}"] - score[w]) for w in known] for u in known])
    start = np.linalg.solve(np.eye(len(known)) - ratio, np.array([10 ** score[u] for u in known]))
    assert (start > 0).all() and abs(start.sum() + 10 ** score[""] - 1) < 1e-9
    assert model.tokens == 30 * 26 and model.vocabulary == len(seen) + 1
    assert all(model.vocabulary <= t <= c <= model.tokens for c, t in zip(model.root_customers, model.root_tables, strict=True))


class Sampler:
    """Customers taken out and seated again one at a time, tables kept as lists of their sizes."""

    def __init__(self, texts, rng, model):
        self.rng, self.m = rng, model
        self.tables, self.root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        self.words = sorted({w for t in texts for w in t.split()}) + [None]
        self.customers = [(u, w) for t in texts for u, w in zip(["<s>", *t.split()], [*t.split(), None], strict=True)]
        for u, w in self.customers:
            self.add(u, w)

    def base(self, w):
        m, n, t = self.m, sum(map(sum, self.root.values())), sum(map(len, self.root.values()))
        own = self.root.get(w, [])
        return (sum(own) - m.root_discount * len(own) + (m.root_strength + m.root_discount * t) / (len(self.words) + 1)) / (m.root_strength + n)

    def chance(self, u, w):
        m, here = self.m, self.tables.get(u, {})
        n, t = sum(map(sum, here.values())), sum(map(len, here.values()))
        own = here.get(w, [])
        return (sum(own) - m.discount * len(own) + (m.strength + m.discount * t) * self.base(w)) / (m.strength + n)

    def sit(self, tables, discount, fresh):
        weights = [s - discount for s in tables] + [fresh]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k == len(tables) - 1 and tables[k] == 1

    def add(self, u, w):
        m, here = self.m, self.tables[u]
        fresh = (m.strength + m.discount * sum(map(len, here.values()))) * self.base(w)
        if self.sit(here[w], m.discount, fresh):
            t = sum(map(len, self.root.values()))
            self.sit(self.root[w], m.root_discount, (m.root_strength + m.root_discount * t) / (len(self.words) + 1))

    def leave(self, tables):
        k = self.rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def sweep(self):
        for u, w in self.customers:
            if self.leave(self.tables[u][w]):
                self.leave(self.root[w])
            self.add(u, w)


def test_against_a_plain_sampler(spark):
    rng = random.Random(9)
    texts = corpus(rng, 40, 15, 12)
    train, probes = texts[:30], [*texts[30:], "w1 never w2", "", "w0"]
    rows = cases.rows(train, TRAINING[:30]) + cases.rows(probes, HELD_OUT[: len(probes)])
    model = py.Model(burn_in=5, strength=2.0)
    got = {r.doc_id: r.score for r in py.score_texts(table(spark, rows), n_sweeps=20, model=model).collect()}
    plain = Sampler(train, rng, model)
    chances, kept = Counter(), 0
    probe_pairs = {t: list(zip(["<s>", *t.split()], [*t.split(), None], strict=True)) for t in probes}
    wanted = {p for pairs in probe_pairs.values() for p in pairs}
    for turn in range(60):
        plain.sweep()
        if turn >= 20:
            kept += 1
            for p in wanted:
                chances[p] += plain.chance(*p)
    for text, i in zip(probes, HELD_OUT, strict=False):
        want = sum(math.log10(chances[p] / kept) for p in probe_pairs[text])
        assert abs(got[i] - want) / len(probe_pairs[text]) < 0.03, (text, got[i], want)


@pytest.mark.parametrize(("n", "others", "parent", "discount", "strength"), [(2, 5, 0.1, 0.75, 20), (7, 3, 0.02, 0.5, 2), (40, 100, 0.3, 0.65, 20), (300, 1000, 0.01, 0.75, 20)])
def test_seating_is_drawn_from_its_distribution(n, others, parent, discount, strength):
    ways = {1: 1.0}  # generalised Stirling numbers of i customers, scaled
    for i in range(1, n):
        more = defaultdict(float)
        for t, x in ways.items():
            more[t] += x * (i - discount * t)
            more[t + 1] += x
        top = max(more.values())
        ways = {t: x / top for t, x in more.items()}
    chance = np.zeros(n + 1)
    for t, x in ways.items():
        chance[t] = math.log(max(x, 1e-300)) + sum(math.log((strength + discount * (others + k)) * parent) for k in range(t))
    chance[0] = -np.inf
    chance = np.exp(chance - chance.max())
    chance /= chance.sum()
    draws = 4000
    drawn = py.seat(np.full(draws, n), parent, others, discount, strength, np.random.default_rng(1).integers(0, 2**63, draws, dtype=np.uint64))
    got = np.bincount(drawn, minlength=n + 1) / draws
    assert np.abs(np.cumsum(got) - np.cumsum(chance)).max() < 0.035


@pytest.mark.parametrize(("parent", "others", "discount", "strength"), [(0.05, 200.0, 0.75, 20.0), (0.3, 2000.0, 0.75, 20.0), (1e-4, 50.0, 0.75, 20.0), (0.02, 5000.0, 0.65, 20.0)])
def test_seating_of_very_many_customers(parent, others, discount, strength, monkeypatch):
    """Beyond EXACT customers the mean and spread stay near those of the exact distribution."""
    seed = np.random.default_rng(2).integers(0, 2**63, 3000, dtype=np.uint64)
    args = (np.full(3000, 390), parent, others, discount, strength, seed)
    exact = py.seat(*args)
    monkeypatch.setattr(py, "EXACT", 60)
    saddle = py.seat(*args)
    assert abs(saddle.mean() - exact.mean()) < 0.05 * exact.mean() + 0.05
    assert abs(saddle.std() - exact.std()) < 0.25 * exact.std() + 0.1


def test_seating_of_huge_dishes():
    seed = np.arange(4, dtype=np.uint64)
    assert py.seat(np.array([0, 1, 10**7, 2**40]), 1e-4, 50.0, 0.75, 20.0, seed).tolist()[:2] == [0, 1]
    assert len(py.seat(np.zeros(0, int), 0.1, 1.0, 0.75, 20.0, seed[:0])) == 0


def test_same_scores_however_cut(spark):
    rows = [r for r in cases.awkward() if r[0] is not None]
    docs = table(spark, rows)
    cut = partial(py._slices, 2000)
    assert docs.repartition(1).selectExpr("doc_id", "true AS held_out", "coalesce(text, '') AS text").mapInArrow(cut, "slice long, packed binary").count() > 5
    names = {t.name for t in spark.catalog.listTables()}
    scores = []
    for parts, size in ((1, 10 << 20), (7, 10 << 20), (1, 2000), (3, 2000)):
        got = py.score_texts(docs.repartition(parts, "doc_id"), slice_bytes=size).collect()
        scores.append(sorted((r.doc_id, r.n_known, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got))
    assert scores[0] == scores[1] == scores[2] == scores[3]
    assert {t.name for t in spark.catalog.listTables()} == names


def test_counts_are_whole_numbers_of_any_size():
    rng = np.random.default_rng(3)
    keys = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(2)]
    keys[1][:100] = keys[0][:100]
    keys = [np.unique(k) for k in keys]
    counts = [np.full(len(k), 3 * 2**32) for k in keys]
    batches = [py._ask(py._PAIRS, one, k, [c], 3) for one, (k, c) in enumerate(zip(keys, counts, strict=True))]
    whole = pa.Table.from_batches(batches)
    answers = [py._answer(py.Model(), 0)(whole.filter(pa.compute.equal(whole.column("bucket"), b))) for b in range(3)]
    told = pa.concat_tables(answers).sort_by([("slice", "ascending"), ("bucket", "ascending")])
    both = np.isin(keys[0], keys[1])
    values = np.concatenate([py._numbers(t.as_py(), n) for t, n, s in zip(told.column("told"), told.column("n").to_pylist(), told.column("slice").to_pylist(), strict=True) if s == 0])
    assert (values >> 1).tolist() == np.where(both, 6 * 2**32, 3 * 2**32).tolist() and (values & 1).all()
    assert [py._keys(k.as_py(), n).tolist() for k, n in zip(whole.column("keys"), whole.column("n").to_pylist(), strict=True)][0] == keys[0][keys[0] < keys[0][whole.column("n")[0].as_py()]].tolist()
