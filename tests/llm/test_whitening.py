"""Whitening against numpy's eigenvectors of exactly summed integers, and the spectral splitting on awkward spectra."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm.queries import QUERIES
from strandloom.llm.whitening import polar_factor, spectral_components, whiten, whitened_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, v string, i string, `a.b c` string"


def fitting(vectors):
    ok = [v for v in vectors if v and all(c is not None and math.isfinite(c) and abs(c) < 2**40 for c in v)]
    size = max(Counter(map(len, ok)).items(), key=lambda x: (x[1], x[0]))[0] if ok else 0
    return lambda v: v in ok and len(v) == size


def check(got, rows, tolerance=1e-7):
    """rows: (id, vector) of vectors that stay."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in x], object)
    covariance = np.array((off.T @ off), float) / n**3
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(32, len(values))
    assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert Counter(i for i, _ in rows) == Counter({i: len(v) // k for i, v in by_id.items()})
    assert got[0].identity_error <= 1e-4
    real = values > 1e-11 * values[0]
    projected = np.array(off / n, float) @ vectors[:, :k] / np.sqrt(np.where(real, values, 1.0))[:k]
    sign = {}
    for (i, _), want, d in zip(rows, projected, off, strict=True):
        own = [r for r in by_id[i] if r.deviation == sum(int(c) ** 2 for c in d)]
        assert len(own) >= k
        for r in own:
            c = r.component - 1
            assert abs(r.explained - values[c] / np.trace(covariance)) <= 1e-9 if values.sum() > 0 else r.explained == 0
            if not real[c]:
                assert r.whitened == 0
            elif min(abs(values[c] - np.delete(values, c))) > 1e-6 * values[0] if len(values) > 1 else True:
                if abs(want[c]) > 1e-3:
                    sign.setdefault(c, np.sign(want[c]) * np.sign(r.whitened))
                    assert abs(r.whitened * sign[c] - want[c]) <= tolerance * max(1, abs(want[c]))


def run(spark, rows, parts=3):
    return whiten(spark.createDataFrame([(i, v, 0, *"cnvix") for i, v in rows], SCHEMA).repartition(parts)).collect()


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * np.geomspace(3, 0.1, d)
    return [[float(np.float32(c)) for c in v] for v in rng.standard_normal((n, d)) @ mix + rng.standard_normal(d) * 5]


@pytest.mark.parametrize("d", [1, 3, 40])
def test_against_numpy(spark, d):
    rows = list(enumerate(vectors(300, d)))
    rows += [(i, rows[7][1]) for i in range(1000, 1150)] + [(7, rows[7][1]), (None, rows[8][1])]
    check(run(spark, rows), rows)


def test_odd_rows(spark):
    good = vectors(60, 5, 1)
    odd = [None, [], [None] * 5, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [1.0, float("inf"), 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [1.0] * 500]
    rows = list(enumerate(good + odd))
    random.Random(1).shuffle(rows)
    stays = fitting([v for _, v in rows])
    check(run(spark, rows), [(i, v) for i, v in rows if stays(v)])


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.5, 3.0])], [(i, [0.5, 0.5]) for i in range(9)], [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]])
def test_components_without_variance(spark, rows):
    check(run(spark, rows), rows)


def test_large_entries_do_not_overflow(spark):
    got = run(spark, [(i, [float((-1) ** i * 2.0**39), float(i)]) for i in range(40)])
    assert {r.deviation for r in got} == {None} and max(abs(abs(r.whitened) - 1) for r in got if r.component == 1) < 1e-9


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_arrays_hold_the_rows(spark):
    df = spark.createDataFrame([(i, v, 0, *"cnvix") for i, v in enumerate(vectors(50, 6))], SCHEMA)
    flat = {(r.vec_id, r.component): r.whitened for r in whiten(df).collect()}
    for r in whitened_vectors(df).collect():
        assert np.allclose(r.whitened, [flat[r.vec_id, c] for c in range(1, 7)], atol=1e-12)


def test_query_on_the_smallest_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    stays = fitting([v for _, v in rows])
    check(QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect(), [r for r in rows if stays(r[1])])


def spectra():
    rng = np.random.default_rng(3)
    yield rng.random(60) * 100
    yield 1 + 1e-10 * np.arange(40)
    yield np.where(np.arange(50) < 5, 3.0, 0.0)
    yield np.repeat([5.0, 1.0, -2.0], [10, 20, 3])
    yield 2.0 ** -np.arange(48)
    yield np.ones(7)
    yield np.zeros(3)
    yield np.array([4.0])


@pytest.mark.parametrize("values", list(spectra()))
def test_spectral_components(values):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((n, n)))[0]
    a = (q * values) @ q.T
    found, vectors = spectral_components((a + a.T) / 2)
    size = max(abs(values).max(), 1e-300)
    assert abs(found - np.sort(values)[::-1]).max() <= 1e-14 * n * size
    assert abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-13
    assert abs(a @ vectors - vectors * found).max() <= 1e-13 * size


def test_polar_factor():
    a = np.random.default_rng(5).standard_normal((30, 30))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert abs(polar_factor(a) - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12
