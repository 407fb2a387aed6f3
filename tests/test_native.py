"""Column expressions that replace kernels, against the kernels or against loops over characters; the trace of polishing."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import kernels as K
from strandloom.functions import model as M
from strandloom.functions import sequences as S
from strandloom.functions import tables
from strandloom.operators import align, assembly, edits, polish

from .test_kernels import edited, mutated

AFFINE = (3, -6, -10, -2)


def lift_case(rng, n, layout):
    copies, slots = layout
    a = "".join(rng.choices("ACGT", k=n))
    b = mutated(rng, a, 3)
    x, y = K.codes(a), K.codes(b)
    path = K.distance_path(K.distance_table(x, y), x, y)
    edits, pos = [], 0
    while pos <= n:
        slot = rng.randrange(slots)
        if rng.random() < 0.3 and edited(a, pos, slot, copies) is not None:
            edits.append((pos, slot))
            pos += max(1, slot - 7 - copies if slot >= 8 + copies else 1)
        pos += 1
    # The edited sequence in one pass over the old one, with the old place of each base (None: new or replaced).
    new, at = [], 0
    for pos, slot in edits:
        new += [(a[p], p) for p in range(at, pos)]
        if slot < 8:
            new.append(("ACGT"[slot % 4], None))
        elif slot < 8 + copies:
            new += [(a[p], None) for p in range(pos, pos + slot - 7)]
        at = pos + (1 if slot < 4 else 0 if slot < 8 + copies else slot - 7 - copies)
    new += [(a[p], p) for p in range(at, n)]
    return a, b, path, edits, new


def check_lifted(b, path, new, lifted):
    assert len(lifted.replace("I", "")) == len(new) and len(lifted.replace("D", "")) == len(b)
    pairs, i, j = set(), 0, 0  # which old base meets which base of the read
    for op in path:
        pairs.add((i if op != "I" else None, j if op != "D" else None))
        i, j = i + (op != "I"), j + (op != "D")
    i = j = 0
    for op in lifted:
        if op in "=X":
            assert new[i][1] is None or (new[i][1], j) in pairs
            assert op == "X" or new[i][1] is None or new[i][0] == b[j]
        elif op == "D":
            assert new[i][1] is None or (new[i][1], None) in pairs
        i, j = i + (op != "I"), j + (op != "D")


@pytest.mark.parametrize("layout", [S.T14, S.T16])
def test_lifted(spark, layout):
    rng = random.Random(layout.copies)
    cases = [lift_case(rng, rng.randint(1, 30), (layout.copies, layout.slots)) for _ in range(120)]
    df = spark.createDataFrame([(k, c[2], c[3]) for k, c in enumerate(cases)] + [(-1, None, [(0, 1)]), (-2, "", [(0, 4)])], "k int, path string, e array<struct<pos:int,slot:int>>").select("k", "e", "path", S.path_columns(F.col("path")).alias("c"))
    none = F.array().cast("array<struct<pos:int,slot:int>>")
    got = {r.k: r for r in df.select("k", "path", S.lifted(F.col("c"), F.col("e"), layout).alias("l"), S.lifted(F.col("c"), none, layout).alias("same")).collect()}
    assert got[-1].l is None and got[-2].l == "D"
    for k, (_, b, path, _, new) in enumerate(cases):
        assert got[k].same == path
        check_lifted(b, path, new, got[k].l)


def cropped(path, start, begin, end):
    """One step at a time: the ranges of path and query on reference positions begin to end."""
    at, q, found = start, 0, None
    for p, op in enumerate(path):
        if at >= end:
            break
        if found is None and at >= begin and op != "I":
            found = [p, p, q, q]
        at, q = at + (op != "I"), q + (op != "D")
        if found:
            found[1], found[3] = p + 1, q
    return found


def test_crop(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("=XID", [6, 1, 2, 2], k=rng.randrange(0, 40))), (s := rng.randrange(5)), (b := rng.randrange(30)), b + rng.randrange(1, 20)) for _ in range(300)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)] + [(-1, None, 0, 0, 5)], "k int, p string, s int, b int, e int").withColumn("r", S.path_runs(F.col("p")))
    got = {r.k: r.c for r in df.select("k", S.crop(F.col("r"), F.col("s"), F.col("b"), F.col("e")).alias("c")).collect()}
    assert got[-1] is None
    for k, row in enumerate(rows):
        want = cropped(*row)
        assert got[k].path_from is None if want is None else tuple(got[k]) == tuple(want)


def test_sub_reads_without_python(spark):
    rows = spark.createDataFrame([("t", 0, "r", "AACGTT", "I==D=II", 3, 4, 7)], "template_id string, chunk_id int, read_id string, seq string, path string, start int, chunk_start int, chunk_end int")
    out = assembly.sub_reads(rows)
    assert [tuple(r) for r in out.collect()] == [("t", 0, "r", "CG", "=D=")]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_sub_reads_in_sql(spark):
    rng = random.Random(8)
    lengths = {f"t{n}": n for n in (0, 5, 12, 30, 47)}
    rows = []
    for k in range(200):
        name = rng.choice(list(lengths))
        start = rng.randrange(max(lengths[name] // 3, 1))
        path = ""
        while sum(c != "I" for c in path) < lengths[name] - start and rng.random() > 0.01:
            path += rng.choices("=XID", [8, 1, 1, 1])[0]
        rows.append((name, k, "".join(rng.choices("ACGT", k=sum(c != "D" for c in path))), path, start, start + sum(c != "I" for c in path)))
    aligned = spark.createDataFrame(rows, "r_name string, read_id int, seq string, path string, start int, end int")
    sizes = spark.createDataFrame(list(lengths.items()), "r_name string, length int")
    spans = assembly.spanned_chunks(aligned, sizes, 12, 4).withColumnRenamed("r_name", "template_id")
    want = sorted(map(tuple, assembly.sub_reads(spans).select("read_id", "chunk_id", "read", "path").collect()))
    tables.register(spark)
    aligned.unionByName(spark.createDataFrame([("t30", -1, None, "=", 0, 1), ("t30", -2, "A", None, 0, 1)], aligned.schema)).createOrReplaceTempView("aligned")
    sizes.createOrReplaceTempView("sizes")
    got = spark.sql("SELECT read_id, s.chunk_id, s.read, s.path FROM aligned JOIN sizes USING (r_name), LATERAL strandloom_sub_reads(seq, path, start, length, 12, 4) s").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 100


def sequences(seed, n, longest=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("ACGT", k=rng.randrange(1, longest)))
    rows = [("ACGT", "ACGT"), ("", "AC"), ("AC", ""), ("", ""), ("AAAA", "CCCC"), (None, "A"), ("A", None)]
    for _ in range(n):
        a = word()
        rows += [(a, word()), (a, mutated(rng, a, 3)), (word() + a, a[len(a) // 3 :] + word())]
    return rows


def test_forward_fold(spark):
    model = M.PairModel(np.random.default_rng(1).dirichlet([4, 1, 1], 3), np.random.default_rng(2).dirichlet([5, 1, 1, 1], 4), np.random.default_rng(3).dirichlet([1] * 4, 5))
    df = spark.createDataFrame(sequences(1, 20), "a string, b string")
    for m in (model, M.default_model()):
        for r in df.select("a", "b", M.forward_log_likelihood(F.col("a"), F.col("b"), m).alias("f")).collect():
            if r.a is None or r.b is None:
                assert r.f is None
            else:
                assert r.f == pytest.approx(float(m.likelihood(K.codes(r.a), K.codes(r.b))), abs=1e-9)


@pytest.mark.parametrize("mode", ["local", "global", "infix", "overlap"])
def test_affine_ends(spark, mode):
    """The kernel's score; and the ends are of an alignment with that score: the parts align globally at it."""
    rows = sequences(2, 15)
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    for r in df.select("a", "b", S.affine_ends(F.col("a"), F.col("b"), AFFINE, mode).alias("f")).collect():
        if r.a is None or r.b is None:
            assert r.f is None
            continue
        assert r.f.score == K.affine(K.codes(r.a), K.codes(r.b), AFFINE, mode)[0]
        part = r.a[r.f.ref_start : r.f.ref_end], r.b[r.f.query_start : r.f.query_end]
        assert r.f.score == (K.affine(*map(K.codes, part), AFFINE)[0] if any(part) else 0)
        if mode == "global":
            assert part == (r.a, r.b)
        if mode == "infix":
            assert part[1] == r.b
        if mode == "overlap":
            assert r.f.ref_end == len(r.a) and (r.f.query_start == 0)


def test_take_reads_ties_and_depth(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(40), "r%d" % i) for i in range(2000)] + [(3, None, "x"), (3, 1, "y"), (3, 1, "y")]
    got = polish.take_reads(spark.createDataFrame(rows, "k int, o int, name string").repartition(5), "k", "o", 7).collect()
    low = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = [r for k in (1, 2, 3, None) for r in sorted((r for r in rows if r[0] == k), key=low)[:7]]
    assert Counter(map(tuple, got)) == Counter(want)


def events(trace, rounds=None):
    return {(r.k, r.round, r.event): r.n for r in trace.collect() if rounds is None or r.round in rounds}


def test_trace_counts_reads_and_edits(spark):
    rng = random.Random(9)
    truth = "".join(rng.choices("ACGT", k=80))
    draft = mutated(rng, truth, 3)
    rows = [(1, mutated(rng, truth, 1), True) for _ in range(20)] + [(1, None, True), (1, truth, False), (1, truth, None), (2, truth, True)]
    drafts = spark.createDataFrame([(1, draft), (2, truth), (3, "ACGT")], "k long, d string")
    done, trace = polish.polish_traced(drafts, spark.createDataFrame(rows, "k long, r string, vote boolean"), "k", "d", "r", 15, take="vote")
    done, got = {r.k: r for r in done.collect()}, events(trace)
    assert done[1].polished == truth and done[3].polished == "ACGT"
    assert got[1, 0, "voted"] == 20 and got[1, 0, "no_sequence"] == 1 and got[1, 0, "not_taken"] == 2 and got[1, 0, "edited"] >= 1
    assert got[2, 0, "voted"] == 1 and (2, 0, "edited") not in got and not any(k == 3 for k, _, _ in got)
    assert sum(n for (k, _, e), n in got.items() if k == 1 and e == "edited") >= 3 and all(got[1, t, "voted"] == 20 for t in range(done[1].rounds + 1))


def test_disagreeing_reads_are_dropped_and_counted(spark):
    """A model that all but forbids insertions and mismatches: a foreign read's numbers leave the range of doubles."""
    rng = random.Random(1)
    truth = "".join(rng.choices("ACGT", k=60))
    model = M.PairModel(np.array(M.DEFAULT_TRANSITIONS), np.where(np.eye(4) > 0, 0.97, 1e-310), np.full(20, 1e-320))
    foreign = "".join(rng.choices("ACGT", k=60))
    x, y = K.codes(truth), K.codes(foreign)
    ahead, behind = model.likelihoods(x, y)
    assert abs(ahead - behind) > K.AGREE and np.isfinite([ahead, behind]).all()
    reads = spark.createDataFrame([(1, truth)] * 5 + [(1, foreign)], "k long, r string")
    drafts = spark.createDataFrame([(1, truth)], "k long, d string")
    rows = edits.read_tables(reads.join(drafts, "k"), ["k"], "d", "r", S.T14, model=model).collect()
    lost = [r for r in rows if r.reason]
    assert [(r.reason, r.reads, r.scores, r.total) for r in lost] == [("disagree", 1, None, None)] and lost[0].forward == pytest.approx(ahead) and lost[0].backward == pytest.approx(behind)
    assert sum(r.reads for r in rows if not r.reason) == 5 and sum(r.total for r in rows if not r.reason) == pytest.approx(5 * float(model.likelihood(x, x)))
    done, trace = polish.polish_traced(drafts, reads, "k", "d", "r", 60, model)
    assert done.first().polished == truth and events(trace, [0]) == {(1, 0, "voted"): 5, (1, 0, "disagree"): 1}
    both = {r.r: r.agrees for r in align.both_likelihoods(reads.join(drafts, "k"), "d", "r", model).collect()}
    assert both == {truth: True, foreign: False}


def test_unreached_reads_are_counted(spark):
    """Without deletions no path leads from a longer draft to a shorter read."""
    model = M.PairModel(np.array([0.9, 0.1, 0, 0.9, 0.1, 0, 1, 0, 0]), np.where(np.eye(4) > 0, 0.97, 0.01), np.full(20, 0.25))
    reads = spark.createDataFrame([(1, "ACGTACGT"), (1, "ACG")], "k long, r string").join(spark.createDataFrame([(1, "ACGTACGT")], "k long, d string"), "k")
    rows = edits.read_tables(reads, ["k"], "d", "r", S.T14, model=model).collect()
    assert sorted((r.reason or "voted", r.reads) for r in rows) == [("unreached", 1), ("voted", 1)]


def bad_paths(spark):
    """Reads along a path up to sixty bases beside the truth, a draft with one wrong base."""
    rng = random.Random(4)
    truth = "".join(rng.choices("ACGT", k=150))
    draft = truth[:75] + ("A" if truth[75] != "A" else "C") + truth[76:]
    bad, good = "I" * 60 + "=D" * 60 + "=" * 30, "=" * 150
    reads = spark.createDataFrame([(1, truth, bad)] * 8 + [(1, truth, good)] * 2, "k long, r string, p string")
    return truth, spark.createDataFrame([(1, draft)], "k long, d string"), reads


def test_second_paths_compete(spark):
    _, drafts, reads = bad_paths(spark)
    rows = reads.selectExpr("k", "r AS read", "true AS forward", "p LIKE 'I%' OR rand(1) < 2 AS votes", "0L AS first", "p AS path").join(drafts.withColumnRenamed("d", "draft"), "k")
    got = polish._contested(rows, "k", 4, M.default_model()).collect()
    assert Counter((r.won, r.path.count("I")) for r in got) == {(True, 0): 8, (False, 0): 2}
    silent = polish._contested(rows.withColumn("votes", F.lit(False)), "k", 4, M.default_model()).collect()
    assert Counter((r.won, r.path.count("I")) for r in silent) == {(False, 60): 8, (False, 0): 2}


def test_second_paths_free_a_stuck_loop(spark, monkeypatch):
    """Where the first round finds no edit, the loop would end with the draft as it was."""
    truth, drafts, reads = bad_paths(spark)
    calls, real = [], polish.choose_edits

    def none_at_first(*args):
        calls.append(1)
        return real(*args) if len(calls) > 1 else real(*args).filter("false")

    monkeypatch.setattr(polish, "choose_edits", none_at_first)
    done, trace = polish.polish_traced(drafts, reads, "k", "d", "r", 4, M.default_model(), path="p")
    assert done.first().polished == truth and events(trace)[1, 0, "second_path"] == 8


def test_a_state_that_returns_ends_the_loop(spark, monkeypatch):
    """Every round proposes the edit that leads back to the state before."""
    swing = {"ACGTACGTAC": 1, "ACGTCCGTAC": 0}

    def swinging(drafts, *_):
        other = F.when(F.col("draft") == "ACGTACGTAC", "ACGTCCGTAC").otherwise("ACGTACGTAC")
        return drafts.select("k", "draft", F.array(F.struct(F.lit(4).alias("pos"), F.when(other == "ACGTCCGTAC", 1).otherwise(0).alias("slot"))).alias("edits"), other.alias("edited"))

    monkeypatch.setattr(polish, "choose_edits", swinging)
    drafts = spark.createDataFrame([(1, "ACGTACGTAC")], "k long, d string")
    reads = spark.createDataFrame([(1, "ACGTACGTAC"), (1, "ACGTCCGTAC")], "k long, r string")
    row = polish.polish(drafts, reads, "k", "d", "r", 6).first()
    assert row.rounds == 1 and row.polished in swing


def test_deep_drafts_are_dealt_to_more_parts(spark, monkeypatch):
    from strandloom.operators import tables

    monkeypatch.setattr(tables, "PART_READS", 4)
    rows = [(1, f"r{i}") for i in range(400)] + [(2, f"s{i}") for i in range(40)]
    monkeypatch.setattr(tables, "partitions", lambda df: 64)
    dealt = tables.spread(spark.createDataFrame(rows, "k long, r string"), "k", "r")
    assert dealt.columns == ["k", "r"] and dealt.count() == 440
    sizes = [r.n for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 40 and max(sizes) < 40
