"""Kernels against definitions: brute force over paths and edited sequences, golden values, properties."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.functions import kernels as K
from strandloom.functions.model import default_model, render
from strandloom.operators.kernels_on_rows import padded

SEQ = st.text("ACGT", max_size=9)
MODEL = default_model()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(seq, pos, slot, copies):
    if slot < 4:
        return seq[:pos] + "ACGT"[slot] + seq[pos + 1 :] if pos < len(seq) else None
    if slot < 8:
        return seq[:pos] + "ACGT"[slot - 4] + seq[pos:]
    n = slot - 7 if slot < 8 + copies else slot - 7 - copies
    if pos + n > len(seq):
        return None
    return seq[: pos + n] + seq[pos:] if slot < 8 + copies else seq[:pos] + seq[pos + n :]


def mutated(rng, seq, n):
    for _ in range(n):
        p = rng.randrange(len(seq) + 1)
        seq = rng.choice([seq[:p] + rng.choice("ACGT") + seq[p:], seq[:p] + seq[p + 1 :], seq[:p] + rng.choice("ACGT") + seq[p + 1 :]])
    return seq


@given(SEQ, SEQ, st.sampled_from(["DI=", "ID=", "=DI"]))
def test_distance_and_path(a, b, ties):
    table = K.distance_table(K.codes(a), K.codes(b))
    path = K.distance_path(table, K.codes(a), K.codes(b), ties)
    assert table[-1, -1] == distance(a, b) == sum(o != "=" for o in path)
    assert sum(o != "I" for o in path) == len(a) and sum(o != "D" for o in path) == len(b)


@pytest.mark.parametrize(("a", "b", "d"), [("AAGTT", "AAGTT", 0), ("AAGTT", "AAGT", 1), ("AAGTT", "", 5), ("AAAA", "A", 3), ("AGCT", "CAT", 3)])
def test_distance_golden(a, b, d):
    assert K.distance_table(K.codes(a), K.codes(b))[-1, -1] == d


@settings(deadline=None, max_examples=60)
@given(SEQ, SEQ, st.sampled_from([(0, 1), (4, 4), (3, 3)]))
def test_edit_table(a, b, size):
    total, table = K.edit_table(K.codes(a), K.codes(b), *size)
    assert total == distance(a, b)
    for pos, slot in itertools.product(range(len(a) + 1), range(8 + sum(size))):
        e = edited(a, pos, slot, size[0])
        assert table[pos, slot] == (K.FAR if e is None else distance(e, b)), (pos, slot)


def test_tables_of_many_pairs():
    rng = random.Random(0)
    a, b = (np.stack([K.codes("".join(rng.choices("ACGT", k=n))) for _ in range(6)]) for n in (17, 15))
    for many, one in ((K.edit_table(a, b, 4, 4), [K.edit_table(x, y, 4, 4) for x, y in zip(a, b, strict=True)]), (MODEL.edit_table(a, b, 3, 3), [MODEL.edit_table(x, y, 3, 3) for x, y in zip(a, b, strict=True)])):
        assert np.allclose(many[0], [o[0] for o in one]) and np.allclose(many[1], [o[1] for o in one])
    assert np.allclose(MODEL.expected(a, b), [MODEL.expected(x, y) for x, y in zip(a, b, strict=True)])
    assert np.allclose(MODEL.viterbi_table(a, b)[:, 2], MODEL.viterbi_table(a[2], b[2]))


def test_band_holds_the_path():
    rng = random.Random(1)
    for _ in range(20):
        a = "".join(rng.choices("ACGT", k=120))
        b = mutated(rng, a, 6)
        x, y = K.codes(a), K.codes(b)
        path = K.distance_path(K.distance_table(x, y), x, y)
        band = K.Band.around([path], len(a), len(b), 12)
        assert band.width < len(a) / 2
        assert K.distance_table(x, y, band)[-1, -1] == distance(a, b)
        assert K.distance_path(K.distance_table(x, y, band), x, y, starts=band.starts[0]) == path
        assert abs(MODEL.likelihood(x, y, band) - MODEL.likelihood(x, y)) < 1e-3
        best, full_best = MODEL.viterbi_path(MODEL.viterbi_table(x, y, band), x, y, band.starts[0]), MODEL.viterbi(x, y)
        assert sorted(best[1]) == sorted(full_best[1]) and abs(best[0] - full_best[0]) < 1e-9  # ties may fall either way
        assert np.allclose(MODEL.expected(x, y, band), MODEL.expected(x, y), atol=1e-3)
        assert K.affine(x, y, (3, -6, -10, -2), band=band) == K.affine(x, y, (3, -6, -10, -2))
        lk, lks = MODEL.edit_table(x, y, 3, 3, band)
        full_lk, full_lks = MODEL.edit_table(x, y, 3, 3)
        near = full_lks > full_lk - 8
        assert abs(lk - full_lk) < 1e-3 and near.any() and np.abs(lks[near] - full_lks[near]).max() < 0.01
        total, table = K.edit_table(x, y, 4, 4, band)
        full_total, full = K.edit_table(x, y, 4, 4)
        assert total == full_total and (table >= full).all() and (table[10:-10] == full[10:-10]).mean() > 0.99


def all_paths(n, m):
    if n == m == 0:
        yield ""
    if n and m:
        yield from (p + "M" for p in all_paths(n - 1, m - 1))
    if m:
        yield from (p + "I" for p in all_paths(n, m - 1))
    if n:
        yield from (p + "D" for p in all_paths(n - 1, m))


def affine_score(path, a, b, scores):
    """None where an insertion follows a deletion."""
    match, mismatch, gap, extend = scores
    total = i = j = 0
    for k, op in enumerate(path):
        if op == "M":
            total += match if a[i] == b[j] else mismatch
            i, j = i + 1, j + 1
        else:
            if op == "I" and k and path[k - 1] == "D":
                return None
            total += extend if k and path[k - 1] == op else gap
            i, j = i + (op == "D"), j + (op == "I")
    return total


@settings(deadline=None, max_examples=40)
@given(st.text("ACGT", max_size=5), st.text("ACGT", max_size=5))
def test_affine(a, b):
    scores = (3, -4, -5, -1)
    best = lambda x, y: max((s for p in all_paths(len(x), len(y)) if (s := affine_score(p, x, y, scores)) is not None))
    parts = lambda s: [s[i:j] for i in range(len(s) + 1) for j in range(i, len(s) + 1)]
    x, y = K.codes(a), K.codes(b)
    score, *_, path = K.affine(x, y, scores)
    assert score == best(a, b) == affine_score(path.replace("=", "M").replace("X", "M"), a, b, scores)
    score, i0, i1, j0, j1, path = K.affine(x, y, scores, "local")
    assert score == max(best(p, q) for p in parts(a) for q in parts(b))
    assert affine_score(path.replace("=", "M").replace("X", "M"), a[i0:i1], b[j0:j1], scores) == score
    if b:
        score, i0, i1, *_, path = K.affine(x, y, scores, "infix")
        assert score == max(best(p, b) for p in parts(a))
        assert len(path.replace("I", "")) == len(a) and len(path.replace("D", "")) == len(b)
        score, *_, path = K.affine(x, y, scores, "overlap")
        assert score == max(best(a[i:], b[:j]) for i in range(len(a) + 1) for j in range(len(b) + 1))
        assert len(path.replace("I", "")) == len(a) and len(path.replace("D", "")) == len(b)


@pytest.mark.parametrize(("a", "b", "score", "path"), [
    ("AAAA", "AAAA", 4, "===="), ("", "", 0, ""), ("ACGT", "ACCT", 2, "==X="), ("ACTGT", "ACGT", 1, "==D=="), ("ACGT", "ACTGT", 1, "==I=="), ("ACTTTGT", "ACGT", -1, "==DDD=="),
])
def test_affine_golden(a, b, score, path):
    found = K.affine(K.codes(a), K.codes(b), (1, -1, -3, -1))
    assert (found[0], found[-1]) == (score, path)


def path_likelihood(path, a, b, model):
    state, i, j, p = 0, 0, 0, 1.0
    x, y = K.codes(a), K.codes(b)
    for op in path:
        to = "MID".index(op)
        p *= model.t[state, to]
        p *= model.e[x[i], y[j]] if op == "M" else model.i[y[j - 1] if j else 4, y[j]] if op == "I" else 1
        i, j, state = i + (op != "I"), j + (op != "D"), to
    return p


def skewed():
    rng = np.random.default_rng(3)
    return K.PairModel(rng.dirichlet([20, 2, 2], 3), rng.dirichlet([3, 1, 1, 1], 4), rng.dirichlet([2, 1, 1, 2], 5))


@settings(deadline=None, max_examples=25)
@given(st.text("ACGT", min_size=1, max_size=4), st.text("ACGT", min_size=1, max_size=4))
def test_hmm_sums_over_paths(a, b):
    model = skewed()
    every = {p: path_likelihood(p, a, b, model) for p in all_paths(len(a), len(b))}
    x, y = K.codes(a), K.codes(b)
    total = sum(every.values())
    assert np.isclose(model.likelihood(x, y), np.log(total))
    score, path = model.viterbi(x, y)
    assert np.isclose(score, np.log(max(every.values())))
    assert np.isclose(every[path.replace("=", "M").replace("X", "M")], max(every.values()))
    down = model.backward(x, y)
    assert np.isclose(down[1][0] + np.log(down[0][0, 0, 0]), np.log(total))
    likelihood, table = model.edit_table(x, y, 3, 3)
    for pos, slot in itertools.product(range(len(a) + 1), range(14)):
        e = edited(a, pos, slot, 3)
        want = -np.inf if e is None else model.likelihood(K.codes(e), y)
        assert np.isclose(table[pos, slot], want) or table[pos, slot] == want, (pos, slot)
    moves = np.zeros((3, 3))
    for p, weight in every.items():
        for before, after in zip("M" + p, p, strict=False):
            moves["MID".index(before), "MID".index(after)] += weight
    share = moves / np.where(moves.sum(1, keepdims=True) > 0, moves.sum(1, keepdims=True), 1)
    assert np.allclose(model.expected(x, y)[:9].reshape(3, 3), share)


@pytest.mark.parametrize(("a", "b", "value"), [("AC", "CT", -8.558810), ("AAAAA", "AAAAA", -0.350964), ("ACCG", "ACCG", -0.281997), ("ATGCCGCACAGTCGAT", "ATCCGC", -31.482463)])
def test_likelihood_golden(a, b, value):
    assert abs(MODEL.likelihood(K.codes(a), K.codes(b)) - value) < 1e-6


@pytest.mark.parametrize(("a", "b", "path"), [("ACCG", "ACCG", "===="), ("ACCG", "", "DDDD"), ("", "ACCG", "IIII"), ("ATGCCGCACAGTCGAT", "ATCCGC", "==D====DDDDDDDDD"), ("CCG", "ACCG", "I===")])
def test_viterbi_golden(a, b, path):
    assert MODEL.viterbi(K.codes(a), K.codes(b))[1] == path


def test_long_pairs_do_not_underflow():
    rng = random.Random(2)
    a = "".join(rng.choices("ACGT", k=1500))
    x, y = K.codes(a), K.codes(mutated(rng, a, 30))
    forward, best = MODEL.likelihood(x, y), MODEL.viterbi(x, y)[0]
    assert np.isfinite(forward) and best < forward < best + 60


def joined(left, right, overlap):
    tail, head = left[-2 * overlap :], right[: 2 * overlap]
    keep, skip = K.overlap_cut(tail, head)
    return left[: len(left) - len(tail) + keep] + right[skip:]


def test_overlap_cut():
    rng = random.Random(5)
    whole = "".join(rng.choices("ACGT", k=300))
    assert joined(whole[:160], whole[120:], 40) == whole
    assert K.overlap_cut("", whole) == (0, 0) and K.overlap_cut(whole, "") == (300, 0)
    broken_end = whole[:150] + "T" * 10
    assert joined(broken_end, whole[120:], 40)[:140] == whole[:140]
    assert joined(broken_end, whole[120:], 40)[-140:] == whole[-140:]
    for _ in range(30):  # the overlap may start anywhere; errors in the unused halves don't show
        start = rng.randrange(85, 115)
        left, right = list(whole[:160]), list(whole[start:])
        left[rng.randrange(155, 160)] = right[rng.randrange(3)] = "A"
        assert joined("".join(left), "".join(right), 40) == whole
    assert len(joined("AAAA", "CCCC", 1)) >= 4


def test_render():
    text = render(MODEL)
    assert text.splitlines()[0] == "MAT\t0.960\t0.020\t0.020" and len(text.splitlines()) == 5


def test_long_pair_in_a_narrow_band():
    rng = random.Random(8)
    a = "".join(rng.choices("ACGT", k=3000))
    b = mutated(rng, a, 60)
    x, y = K.codes(a), K.codes(b)
    band = K.Band.around([None], len(a), len(b), 40)
    table = K.distance_table(x, y, band)
    assert table.shape == (len(b) + 1, 81) and table[-1, -1] == distance(a, b)
    path = K.distance_path(table, x, y, starts=band.starts[0])
    assert sum(o != "=" for o in path) == table[-1, -1]
    again = K.Band.around([path], len(a), len(b), 12)
    assert K.distance_table(x, y, again)[-1, -1] == table[-1, -1] and again.width < 60
    assert 0 <= MODEL.likelihood(x, y, band) - MODEL.viterbi_path(MODEL.viterbi_table(x, y, band)[:, :], x, y, band.starts[0])[0] < 100


def test_no_path():
    never = K.PairModel(np.array([1, 0, 0] * 3), np.eye(4), np.full(20, 0.25))
    x, y = K.codes("ACGT"), K.codes("ACG")
    score, path = never.viterbi(x, y)
    assert score == -700 and path.count("=") == 3 and path.count("D") == 1
    far = np.full((4, 5), K.FAR)
    assert K.distance_path(far, x, y) is None
    assert K.Band.around([None], 4, 3, 1).starts.shape == (1, 4) and K.straight_path(0, 3) == "III" and K.straight_path(3, 0) == "DDD" and K.straight_path(0, 0) == ""


def test_adapted_radius():
    out = K.adapted_radius(np.full(41, 20), "=" * 20 + "I" + "=" * 19, [10], 6)
    assert out[0] == 10 and out[12] == 6 and out[5:18].tolist() == [6] * 13 and out[30] == 10
    assert K.adapted_radius(np.full(41, 6), "=" * 40, [], 6).tolist() == [4] * 41
    a, b = "ACGTACGTACGTACGTACGT", "ACGTACGTACGTACGTACGT"
    x, y = K.codes(a), K.codes(b)
    uneven = K.Band.around(["=" * 20], 20, 20, [np.where(np.arange(21) < 10, 2, 6)])
    low, high = K.path_bands(["=" * 20], 20, 20, np.where(np.arange(21) < 10, 2, 6))
    assert (high - low)[0, 2] < (high - low)[0, 14] and K.distance_table(x, y, uneven)[-1, -1] == 0


@given(st.text("=ID", max_size=12), st.integers(0, 8), st.integers(0, 8), st.integers(0, 4))
def test_path_bands(path, n, m, radius):
    cells, i, j = {(0, 0)}, 0, 0
    for op in path:
        i, j = i + (op != "D"), j + (op != "I")
        cells.add((i, j))
    while i < m or j < n:
        i, j = min(i + 1, max(i, m)), min(j + 1, max(j, n))
        cells.add((i, j))
    cells = {c for c in cells if c[0] <= m and c[1] <= n}
    low, high = K.path_bands([path], n, m, np.asarray(radius))
    for row in range(m + 1):
        near = [b for b in range(n + 1) if any(abs(row - c) + abs(b - d) <= radius for c, d in cells)]
        assert not near or (low[0, row] <= near[0] and high[0, row] >= near[-1] + 1)
    assert (np.diff(low[0]) >= 0).all() and (np.diff(high[0]) >= 0).all()


@pytest.mark.parametrize("radius", [None, 6])
def test_padded_pairs(radius):
    """Pairs that begin with pads have the tables and paths they have alone (in a band: paths as short as their totals say)."""
    rng, model = random.Random(3), default_model()
    rows = [(a, mutated(rng, a, 3)) for a in ("".join(rng.choices("ACGT", k=rng.randrange(1, 60))) for _ in range(150))] + [("", ""), ("", "AC"), ("ACG", ""), (None, "A")]
    frame, seen, with_pads = pd.DataFrame({0: [r[0] for r in rows], 1: [r[1] for r in rows], 2: pd.Series([None] * len(rows), dtype=object)}), [], 0
    for places, x, y, band, pads in padded(frame, radius):
        seen += places.tolist()
        (total, table), best, steps = K.edit_table(x, y, 3, 3, band), model.viterbi_table(x, y, band), K.distance_table(x, y, band)
        likely, edited_likely, behind = model.edit_table(x, y, 3, 3, band, back=True)
        np.testing.assert_allclose(likely, behind, atol=1e-9)
        for k, (p, pad) in enumerate(zip(places.tolist(), pads, strict=True)):
            with_pads += pad > 0
            a, b = K.codes(rows[p][0]), K.codes(rows[p][1])
            assert (x[k, pad:] == a).all() and (y[k, pad:] == b).all() and (x[k, :pad] == K.PAD).all()
            path = K.distance_path(steps[k, pad:], a, b, "ID=", band.starts[k, pad:] - pad)
            assert len(path) - path.count("=") == total[k] and len(path) - path.count("I") == len(a) and len(path) - path.count("D") == len(b)
            if radius is None:
                alone, alone_likely = K.edit_table(a, b, 3, 3), model.edit_table(a, b, 3, 3)
                assert alone[0] == total[k] and (alone[1] == table[k, pad:]).all()
                assert path == K.distance_path(K.distance_table(a, b), a, b, "ID=")
                np.testing.assert_allclose(alone_likely[0], likely[k], atol=1e-9)
                np.testing.assert_allclose(alone_likely[1], edited_likely[k, pad:], atol=1e-9)
                (score, _), (padded_score, padded_path) = model.viterbi(a, b), model.viterbi_path(best[:, k, pad:], a, b, band.starts[k, pad:] - pad)
                # Rounding may tell apart paths that tie, so only what they are worth is the same.
                assert abs(score - padded_score) < 1e-9 and len(padded_path) - padded_path.count("I") == len(a) and len(padded_path) - padded_path.count("D") == len(b)
    assert sorted(seen) == list(range(len(rows) - 1)) and with_pads > 50


@pytest.mark.parametrize("radius", [None, 12])
def test_pairs_of_mixed_lengths(radius):
    """Queries short by different numbers of bases share calls behind skipped rows, and have the tables and paths they have alone."""
    rng, model = random.Random(4), default_model()
    rows = [(a, mutated(rng, a, rng.randrange(7))) for a in ("".join(rng.choices("ACGT", k=rng.randrange(1, 60))) for _ in range(120))] + [("", ""), ("", "AC"), ("ACG", ""), ("AC", "ACGTACGT"), (None, "A")]
    frame, seen, calls, skipped = pd.DataFrame({0: [r[0] for r in rows], 1: [r[1] for r in rows], 2: pd.Series([None] * len(rows), dtype=object)}), [], 0, 0
    for places, x, y, band, pads in padded(frame, radius, mixed=True):
        seen, calls = seen + places.tolist(), calls + 1
        (total, table), best, steps = K.edit_table(x, y, 3, 3, band), model.viterbi_table(x, y, band), K.distance_table(x, y, band)
        likely, edited_likely, behind = model.edit_table(x, y, 3, 3, band, back=True)
        np.testing.assert_allclose(likely, behind, atol=1e-9)
        np.testing.assert_allclose(likely, model.likelihood(x, y, band), atol=1e-9)
        for k, (p, pad) in enumerate(zip(places.tolist(), pads, strict=True)):
            a, b = K.codes(rows[p][0]), K.codes(rows[p][1])
            row = y.shape[-1] - len(b)
            skipped += row > pad
            assert (x[k, pad:] == a).all() and (y[k, row:] == b).all() and (y[k, : row - pad] == K.SKIP).all() and (y[k, row - pad : row] == K.PAD).all()
            path = K.distance_path(steps[k, row:], a, b, "ID=", band.starts[k, row:] - pad)
            assert len(path) - path.count("=") == total[k] and len(path) - path.count("I") == len(a) and len(path) - path.count("D") == len(b)
            if radius is None:
                alone, alone_likely = K.edit_table(a, b, 3, 3), model.edit_table(a, b, 3, 3)
                assert alone[0] == total[k] and (alone[1] == table[k, pad:]).all()
                assert path == K.distance_path(K.distance_table(a, b), a, b, "ID=")
                np.testing.assert_allclose(alone_likely[0], likely[k], atol=1e-9)
                np.testing.assert_allclose(alone_likely[1], edited_likely[k, pad:], atol=1e-9)
                (score, _), (mixed_score, mixed_path) = model.viterbi(a, b), model.viterbi_path(best[:, k, row:], a, b, band.starts[k, row:] - pad)
                assert abs(score - mixed_score) < 1e-9 and len(mixed_path) - mixed_path.count("I") == len(a) and len(mixed_path) - mixed_path.count("D") == len(b)
    assert sorted(seen) == list(range(len(rows) - 1)) and skipped > 50
    assert calls < sum(1 for _ in padded(frame, radius))


def test_paths_at_once_are_those_of_single_pairs():
    """Padded pairs of a batch traced back together, with and without bands, for either table."""
    rng = random.Random(3)
    frame = pd.DataFrame([(a := "".join(rng.choices("ACGT", k=rng.randint(18, 20))), mutated(rng, a, 3), None) for _ in range(300)], columns=[0, 1, 2])
    for radius in (None, 4):
        sizes = []
        for places, x, y, band, pads in padded(frame, radius, mixed=True):
            rows = y.shape[-1] - np.array([len(frame[1][p]) for p in places.tolist()])
            cut = [(k, r, p, x[k, p:], y[k, r:], band.starts[k, r:] - p) for k, (r, p) in enumerate(zip(rows.tolist(), pads, strict=True))]
            table, best = K.distance_table(x, y, band), MODEL.viterbi_table(x, y, band)
            assert table.dtype == np.int32
            for order in ("DI=", "ID="):
                assert K.distance_paths(table, x, y, order, band.starts, rows, np.array(pads)) == [K.distance_path(table[k, r:], a, b, order, s) for k, r, _, a, b, s in cut]
            assert MODEL.viterbi_paths(best, x, y, band.starts, rows, np.array(pads)) == [MODEL.viterbi_path(best[:, k, r:], a, b, s) for k, r, _, a, b, s in cut]
            sizes.append(len(places))
        assert max(sizes) >= K.FEW


@pytest.mark.parametrize("mode", ["global", "local", "infix", "overlap"])
@pytest.mark.parametrize("radius", [None, 6])
def test_affine_paths_of_many_pairs_are_those_of_single_ones(mode, radius, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 4, (300, 23)).astype(np.uint8), rng.integers(0, 4, (300, 21)).astype(np.uint8)
    y[:250] = np.delete(x[:250], [4, 15], 1)
    y[:250, 9] = (y[:250, 9] + 1) % 4
    band = None if radius is None else K.Band.around([None] * 300, 23, 21, radius)
    traced = []
    monkeypatch.setattr(K, "_affine_path", lambda *a, f=K._affine_path: traced.append(1) or f(*a))
    many = K.affine_pairs(x, y, (3, -6, -10, -2), mode, band)
    assert not traced
    monkeypatch.setattr(K, "FEW", 1000)
    assert many == K.affine_pairs(x, y, (3, -6, -10, -2), mode, band) and len(traced) == 300


@pytest.mark.parametrize("wide", [False, True])
def test_tables_of_few_bits(monkeypatch, wide):
    """Short pairs have distances of 16 bits, and windows of more than half of a row are whole rows with an outside: results are those
    of wide numbers and of windows that are cut out."""
    rng = random.Random(5)
    pairs = [(a := "".join(rng.choices("ACGT", k=23)), mutated(rng, a, 3)) for _ in range(80)]
    pairs = [(a, (b + "ACGTA")[:23]) for a, b in pairs]
    x, y = (np.stack([K.codes(p[k]) for p in pairs]) for k in (0, 1))
    whole = K.Band.around([None] * 80, 23, 23, 8)
    assert whole.outside is not None and not whole.starts.any()
    cells = ~whole.outside
    cut = K.Band(np.ascontiguousarray(cells.argmax(1).T), int(cells.sum(1).max()))
    if wide:
        monkeypatch.setattr(K, "_NEAR", 0)
    for one, other in ((K.edit_table(x, y, 4, 4, whole), K.edit_table(x, y, 4, 4, cut)), (MODEL.edit_table(x, y, 3, 3, whole, back=True), MODEL.edit_table(x, y, 3, 3, cut, back=True)), ((MODEL.expected(x, y, whole),), (MODEL.expected(x, y, cut),))):
        for a, b in zip(one, other, strict=True):
            np.testing.assert_allclose(np.maximum(a.astype(float), -1e30), np.maximum(b.astype(float), -1e30), rtol=1e-9, atol=1e-12)
    same = [(K.distance_table(x, y, b), b) for b in (whole, cut)]
    assert K.distance_paths(same[0][0], x, y, "ID=", whole.starts, np.zeros(80, int), np.zeros(80, int)) == K.distance_paths(same[1][0], x, y, "ID=", cut.starts, np.zeros(80, int), np.zeros(80, int))
    assert same[0][0].dtype == np.int32 and (same[0][0] == K.FAR).any()
