"""Operators as Spark jobs: polishing recovers the truth, training, assembly, sources, streaming, simulation."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import kernels as K
from strandloom.functions import model as M
from strandloom.functions import sequences as S
from strandloom.operators import align, assembly, edits, fit, polish, simulate, windows
from strandloom.sources import alignments
from strandloom.streaming.tables import streaming_table

from .test_kernels import distance, edited, mutated


def test_path_columns(spark):
    row = spark.createDataFrame([("=XDID=", "10M2I3D4S", "AcgTN", None)], "p string, c string, s string, n string").select(
        S.flip(F.col("p")), S.reference_length(F.col("p")), S.query_length(F.col("p")), S.nonmatches(F.col("p")), S.cigar_path(F.col("c")),
        S.clean(F.col("s")), S.reverse_complement(F.lit("AACG")), S.flip(F.col("n")), S.cigar_path(F.lit("3M2N3M")), S.base_index(F.lit("g")), S.base_index(F.lit("N")), S.clamped_log(F.lit(0.0)),
    ).first()
    assert tuple(row) == ("=XIDI=", 5, 4, 4, "=" * 10 + "II" + "DDD" + "IIII", "ACGT", "CGTT", None, None, 2, 0, -1e31)


def test_three_way(spark):
    a = spark.range(1).select(S.three_way(F.lit("ACGTA"), F.lit("ATGA"), F.lit("=X=D=")).alias("a")).first()["a"]
    assert (a["ref"], a["mid"], a["query"]) == ("ACGTA", "|X| |", "ATG A")


@pytest.mark.parametrize("layout", [S.T9, S.T14, S.T16])
def test_edit_columns(spark, layout):
    seq = "ACGTTGCA"
    rows = edits.all_edits(spark.createDataFrame([(1, seq)], "k long, d string"), "k", "d", layout).collect()
    want = {(p, s): e for p in range(len(seq) + 1) for s in range(layout.slots) if (e := edited(seq, p, s, layout.copies)) is not None}
    assert {(r.pos, r.slot): r.edited for r in rows} == want
    kinds = spark.range(layout.slots).select(S.slot_kind(F.col("id"), layout).alias("k")).collect()
    assert [r["k"]["kind"] for r in kinds] == ["sub"] * 4 + ["ins"] * 4 + ["copy"] * layout.copies + ["del"] * layout.deletions


def test_greedy_and_apply(spark):
    rows = [(0, 1), (3, 5), (7, 12), (9, 13), (14, 9), (20, 2), (20, 6)]
    seq = "ACGTACGTACGTACGTACGT"
    df = spark.createDataFrame([(seq, [{"pos": p, "slot": s} for p, s in rows])], "s string, r array<struct<pos:int,slot:int>>")
    taken = df.select("s", S.greedy_edits(F.col("r"), F.lit(2), S.T16, F.length("s")).alias("e")).select("e", S.apply_edits(F.col("s"), F.col("e"), S.T16).alias("x")).first()
    assert [tuple(e) for e in taken["e"]] == [(0, 1), (3, 5), (7, 12), (14, 9), (20, 6)]
    want = seq
    for p, s in reversed([tuple(e) for e in taken["e"]]):
        want = edited(want, p, s, 4)
    assert taken["x"] == want


def test_tables_agree(spark):
    rng = random.Random(0)
    truth = ["".join(rng.choices("ACGT", k=18)) for _ in range(3)]
    drafts = spark.createDataFrame([(k, mutated(rng, t, 2)) for k, t in enumerate(truth)], "k long, d string")
    reads = spark.createDataFrame([(k, mutated(rng, t, 1)) for k, t in enumerate(truth) for _ in range(6)], "k long, r string")
    native = edits.native_table(drafts, reads, "k", "d", "r", S.T16).collect()
    kernel = edits.summed_tables(edits.read_tables(reads.join(drafts, "k"), ["k"], "d", "r", S.T16), "k", S.T16).collect()
    assert {(r.k, r.pos, r.slot): r.score for r in native} == {(r.k, r.pos, r.slot): int(r.score) for r in kernel}


@pytest.mark.parametrize("model", [None, M.default_model()])
def test_polish_recovers(spark, model):
    rng = random.Random(7)
    truth = {k: "".join(rng.choices("ACGT", k=rng.randint(60, 90))) for k in range(4)}
    drafts = spark.createDataFrame([(k, mutated(rng, t, 5)) for k, t in truth.items()] + [(99, "ACGT")], "k long, d string")
    reads = spark.createDataFrame([(k, mutated(rng, t, 2)) for k, t in truth.items() for _ in range(20)], "k long, r string")
    got = {r.k: r for r in polish.polish(drafts, reads, "k", "d", "r", 20, model).collect()}
    assert got[99].polished == "ACGT" and got[99].rounds == 0
    assert {k: got[k].polished for k in truth} == truth


def noisy(rng, seq, rate=0.01):
    """`seq` with a base in a hundred replaced, as many inserted and as many lost."""
    out = []
    for base in seq:
        x = rng.random()
        out += [] if x < rate else [base.translate(str.maketrans("ACGT", "CGTA"))] if x < 2 * rate else [rng.choice("ACGT"), base] if x < 3 * rate else [base]
    return "".join(out)


def test_exact_recovery_by_distance(spark):
    rng = random.Random(1)
    truth = {k: "".join(rng.choices("ACGT", k=20 + k)) for k in range(0, 100, 5)}
    drafts = spark.createDataFrame([(k, noisy(rng, t)) for k, t in truth.items()], "k long, d string")
    reads = spark.createDataFrame([(k, noisy(rng, t)) for k, t in truth.items() for _ in range(30)], "k long, r string")
    assert {r.k: r.polished for r in polish.polish(drafts, reads, "k", "d", "r", 20).collect()} == truth


def test_exact_recovery_from_one_read(spark):
    rng = random.Random(2)
    truth = {k: "".join(rng.choices("ACGT", k=70)) for k in range(10)}
    drafts = spark.createDataFrame([(k, mutated(rng, t, 6)) for k, t in truth.items()], "k long, d string")
    reads = spark.createDataFrame(list(truth.items()), "k long, r string")
    assert {r.k: r.polished for r in polish.polish(drafts, reads, "k", "d", "r", 50, M.default_model()).collect()} == truth


def test_polish_options(spark):
    rng = random.Random(8)
    truth = "".join(rng.choices("ACGT", k=70))
    draft = "ACGT"[("ACGT".index(truth[1]) + 1) % 4].join([truth[:1], truth[2:]])
    draft = draft[:40] + draft[41:]
    drafts = spark.createDataFrame([(1, draft)], "k long, d string")
    rows = [(1, mutated(rng, truth, 1), n % 2 == 0, n < 14) for n in range(14)] + [(1, draft, True, False)] * 30
    reads = spark.createDataFrame(rows, "k long, r string, fwd boolean, vote boolean")
    both = {True: M.default_model(), False: K.PairModel(M.default_model().t, M.default_model().e, M.default_model().i)}
    assert polish.polish(drafts, reads, "k", "d", "r", 15, both, strand="fwd", take="vote").first().polished == truth
    assert polish.polish(drafts, reads, "k", "d", "r", 15, take="vote").first().polished == truth
    inner = polish.polish(drafts, reads, "k", "d", "r", 15, take="vote", ignore_edge=5).first().polished
    assert inner[:5] == draft[:5] and inner[5:] == truth[5:]


def test_polish_exactly(spark):
    rng = random.Random(9)
    truth = {k: "".join(rng.choices("ACGT", k=22)) for k in range(3)}
    drafts = spark.createDataFrame([(k, mutated(rng, t, 2)) for k, t in truth.items()] + [(9, "AC")], "k long, d string")
    reads = spark.createDataFrame([(k, t if n % 3 else mutated(rng, t, 1)) for k, t in truth.items() for n in range(12)], "k long, r string")
    got = {r.k: r.polished for r in polish.polish_exactly(drafts, reads, "k", "d", "r").collect()}
    assert got == truth | {9: "AC"}


@pytest.mark.parametrize("start, end", [(0, 39), (0, 40), (5, 45), (7, 68), (3, 103), (3, 104)])
def test_split_windows(spark, start, end):
    got = sorted((r.start, r.end) for r in windows.split_windows(spark.createDataFrame([(1, start, end)], "k long, start int, end int"), 10).collect())
    assert got[0][0] == start and got[-1][1] == end and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert len(got) == 1 or all(e - s == 20 for s, e in got[:-1])
    assert (end - start < 40) <= (len(got) == 1) and 0 < got[-1][1] - got[-1][0] <= 40


def test_polish_windows(spark):
    rng = random.Random(21)
    truth = {k: "".join(rng.choices("ACGT", k=160)) for k in range(3)}
    drafts = spark.createDataFrame([(k, mutated(rng, t, 5)) for k, t in truth.items()] + [(9, "ACGT")], "k long, d string")
    reads = spark.createDataFrame([(k, mutated(rng, t, 2)) for k, t in truth.items() for _ in range(20)], "k long, r string")
    before = {r.k: r.d for r in drafts.collect()}
    focused = {r.k: r for r in windows.polish_focused(drafts, reads, "k", "d", "r").collect()}
    assert focused[9].polished == "ACGT" and {k: r.draft for k, r in focused.items()} == before
    for k, t in truth.items():
        assert distance(focused[k].polished, t) < distance(before[k], t)
    assert {r.k: r.polished for r in windows.polish_banded(drafts, reads, "k", "d", "r").collect()} == truth | {9: "ACGT"}


def test_model_sampler(spark):
    base = spark.range(40).select(F.col("id").alias("k"), simulate.random_sequence(F.lit(150), F.col("id")).alias("s"))
    model = M.default_model()
    rows = base.select("s", simulate.sampled(F.col("s"), model, F.col("k")).alias("r")).collect()
    rate = sum(distance(r.s, r.r) for r in rows[:15]) / (15 * 150)
    assert 0.04 < rate < 0.11 and abs(sum(len(r.r) for r in rows) / (40 * 150) - 1) < 0.05


def test_take_reads(spark):
    rows = polish.take_reads(spark.range(20).select((F.col("id") % 3).alias("k"), "id"), "k", "id", 4).collect()
    assert Counter(r.k for r in rows) == {0: 4, 1: 4, 2: 4} and max(r.id for r in rows) == 11


def test_alignment_columns(spark):
    rng = random.Random(3)
    rows = [(k, (a := "".join(rng.choices("ACGT", k=40))), mutated(rng, a, 4)) for k in range(12)] + [(50, None, "A"), (51, "", "AC")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    for r in align.edit_paths(df, "a", "b", radius=15).collect():
        assert r.distance == (None if r.a is None else distance(r.a, r.b))
    for r in align.affine_paths(df, "a", "b", (3, -6, -10, -2), radius=15).collect():
        assert r.score == (None if r.a is None else K.affine(K.codes(r.a), K.codes(r.b), (3, -6, -10, -2))[0])
    model = M.default_model()
    exact = {r.k: r.log_likelihood for r in align.likelihoods(df, "a", "b").collect()}
    for r in align.best_paths(df, "a", "b", radius=15).select("k", "a", "b", "log_likelihood", "ops", M.path_log_likelihood(F.col("a"), F.col("b"), F.col("ops"), model).alias("again")).collect():
        if r.a is None:
            assert r.ops is None and exact[r.k] is None
        else:
            assert r.log_likelihood <= exact[r.k] + 1e-9 and abs(r.log_likelihood - r.again) < 1e-6


def test_bootstrap_path(spark):
    for n, m in [(5, 5), (7, 3), (3, 7), (4, 0), (0, 4), (10, 9)]:
        path = spark.range(1).select(S.bootstrap_path(F.lit(n), F.lit(m)).alias("p")).first().p
        assert len(path.replace("I", "")) == n and len(path.replace("D", "")) == m


def test_fit(spark):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        a = "".join(rng.choices("ACGT", k=80))
        rows.append((a, mutated(rng, a, 8 if k % 2 else 1), bool(k % 2)))
    df = spark.createDataFrame(rows, "a string, b string, fwd boolean")
    start = {True: M.default_model(), False: M.default_model()}
    models = fit.fit(df, "a", "b", start, 2, strand="fwd", radius=20)
    assert models[True].t[0, 0] < models[False].t[0, 0]
    for m in models.values():
        assert np.allclose(m.t.sum(1), 1) and np.allclose(m.e.sum(1), 1) and np.allclose(m.i.sum(1), 1)
    for forward in (True, False):
        own = [(a, b) for a, b, f in rows if f == forward]
        before, after = (sum(float(m[forward].likelihood(K.codes(a), K.codes(b))) for a, b in own) for m in (start, models))
        assert after > before
    assert fit.fit_step(df.filter("fwd"), "a", "b", start, strand="fwd")[False] is start[False]


def test_model_tables(spark):
    model = M.default_model()
    frame = M.to_frame(spark, model)
    again = M.from_row(M.from_json(M.to_json(frame)).first())
    assert np.allclose(again.t, model.t) and np.allclose(again.e, model.e) and np.allclose(again.i, model.i)
    assert json.loads(M.to_json(frame).first()["model"])["mat_mat"] == 0.96
    scaled = frame.withColumns({t: F.col(t) * 3 for t in M.TRANSITIONS} | {"mat_emit": F.transform("mat_emit", lambda x: x * 7)})
    back = M.from_row(M.normalised(scaled).first())
    assert np.allclose(back.t, model.t) and np.allclose(back.e, model.e)


def test_three_way_and_distance_of_odd_rows(spark):
    rows = [("ACGT", "AGT", "=D=="), ("ACGT", "ACTTG", "==X=I"), ("", "AC", "II"), ("AC", "", "DD"), ("", "", ""), (None, "A", "I"), ("A", None, "D"), ("A", "A", None), ("GA", "TTGAC", "II==I")]
    frame = spark.createDataFrame(rows, "r string, q string, p string")
    got = frame.select(S.three_way(F.col("r"), F.col("q"), F.col("p")).alias("a"), S.edit_distance_by_rows(F.col("r"), F.col("q")).alias("d"), F.levenshtein("r", "q").alias("want")).collect()
    assert [tuple(g["a"]) for g in got] == [
        ("ACGT", "| ||", "A GT"), ("ACGT ", "||X| ", "ACTTG"), ("  ", "  ", "AC"), ("AC", "  ", "  "), ("", "", ""), (None,) * 3, (None,) * 3, (None,) * 3, ("  GA ", "  || ", "TTGAC"),
    ]
    assert [g["d"] for g in got] == [g["want"] for g in got]


def test_log_sum_exp_of_nothing(spark):
    frame = spark.createDataFrame([([],), ([-2.0],)], "v array<double>")
    assert [r[0] for r in frame.select(S.log_sum_exp(F.col("v"), S.LOG_ZERO)).collect()] == [S.LOG_ZERO, -2.0]


def test_log_sum_exp(spark):
    got = spark.createDataFrame([([-1000.0, -1001.0],), ([],)], "v array<double>").select(S.log_sum_exp(F.col("v")).alias("x")).collect()
    assert abs(got[0].x - (-1000 + np.log1p(np.exp(-1)))) < 1e-9 and got[1].x == 0


def test_assembly(spark):
    rng = random.Random(5)
    truth = {"t1": "".join(rng.choices("ACGT", k=230)), "t2": "".join(rng.choices("ACGT", k=60)), "alone": "ACGTACGT"}
    templates = {k: (t if k == "alone" else t[:50] + "ACGT"[("ACGT".index(t[50]) + 1) % 4] + t[51:]) for k, t in truth.items()}
    reads, sam = [], []
    for k in ("t1", "t2"):
        for n in range(12):
            seq = truth[k]
            rev = n % 2 == 1
            name = f"{k}-{n}"
            reads.append((name, seq[::-1].translate(str.maketrans("ACGT", "TGCA")) if rev else seq))
            sam.append((name, k, 16 if rev else 0, 1, f"{len(seq)}M"))
    sam += [("t1-0", "t1", 4, 0, "*"), ("ghost", "t1", 0, 1, "10M"), ("t1-1", "t1", 0, 1, "5M3N5M")]
    frames = spark.createDataFrame(list(templates.items()), "id string, seq string"), spark.createDataFrame(reads, "id string, seq string"), spark.createDataFrame(sam, "q_name string, r_name string, flag int, pos int, cigar string")
    got = {r.id: r.seq for r in assembly.polish_assembly(*frames, chunk_size=80, overlap=15, radius=10).collect()}
    assert got == truth


def test_chunks_cover(spark):
    rows = spark.createDataFrame([(str(n), "A" * n) for n in (0, 5, 10, 11, 16, 17, 100)], "id string, seq string")
    got = assembly.chunk_grid(rows, 10, 4).collect()
    for n in (5, 10, 11, 16, 17, 100):
        own = sorted((r.start, r.end) for r in got if r.template_id == str(n))
        assert own[0][0] == 0 and own[-1][1] == n and all(b[0] < a[1] for a, b in zip(own, own[1:], strict=False))
    assert not [r for r in got if r.template_id == "0"]


def test_merge_windows(spark):
    rows = spark.createDataFrame([(1, p) for p in (5, 10, 40, 90, 95)] + [(2, 7)], "k long, pos long")
    assert sorted(map(tuple, edits.merge_windows(rows, "k", 10).select("k", "start", "end").collect())) == [(1, -5, 20), (1, 30, 50), (1, 80, 105), (2, -3, 17)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nq1\t0\tr1\t3\t60\t5M\t*\t0\t0\tACGTA\t*\nbad line\nq2\t16\tr1\t0\t60\t*\n")
    assert sorted(map(tuple, alignments.read_sam(spark, str(tmp_path / "a.sam")).collect())) == [("q1", "r1", 0, 3, "5M"), ("q2", "r1", 16, 0, "*")]
    (tmp_path / "a.fa").write_text(">s1 about\nACG\nTTa\n>s2\nGG\n")
    assert sorted(map(tuple, alignments.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("s1", "ACGTTA"), ("s2", "GG")]
    (tmp_path / "c.tsv").write_text("a\tb\tc\tACGT\nx\ty\tz\tACG\nx\ty\tz\tAGT\textra\n")
    draft, reads = alignments.read_cluster(spark, str(tmp_path / "c.tsv"))
    assert draft.first().seq == "ACGT" and [r.seq for r in reads.orderBy("idx").collect()] == ["ACG", "AGT"]
    alignments.write_timings(spark.createDataFrame([(12, 3)], "micros long, diff long"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "12\t3"
    shown = alignments.rendered(spark.createDataFrame([("A" * 30, "C" * 30, "X" * 30), ("A", "A", "=")], "r string, q string, p string"), "r", "q", "p", width=20, worse_than=5).collect()
    assert len(shown) == 1 and shown[0].text.split("\n")[1] == "X" * 20


def test_clusters_in_byte_ranges(spark, tmp_path):
    folder = tmp_path / "clusters"
    folder.mkdir()
    lines = {f"c{k}.tsv": [f"{k}\t{i}\tx\t{'ACGT'[i % 4] * (1 + i % 50)}" if i % 97 != 5 else "short line" for i in range(n)] for k, n in enumerate((3000, 1, 800))}
    lines["c3.tsv"] = ["no sequence here", "a\tb\tc\tAC"]
    for name, rows in lines.items():
        (folder / name).write_text("\n".join(rows) + "\n")
    (folder / "empty.tsv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(str(folder / "c0.tsv")).rdd.getNumPartitions() > 5
        draft, reads = alignments.read_cluster(spark, str(folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted((r.file.rsplit("/", 1)[-1], r.idx, r.seq) for r in draft.unionByName(reads).collect())
    assert got == sorted((name, i, row.split("\t")[3]) for name, rows in lines.items() for i, row in enumerate(rows) if row.count("\t") >= 3)
    assert sorted(r.file.rsplit("/", 1)[-1] for r in draft.collect()) == ["c0.tsv", "c1.tsv", "c2.tsv"]


def test_streaming_table(spark, tmp_path):
    drafts = spark.createDataFrame([(1, "ACGT"), (2, "GGG")], "k long, d string")
    batches = [[(1, "ACT"), (2, "GG")], [(1, "ACGTT"), (3, "A")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, r string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    stream = spark.readStream.schema("k long, r string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = streaming_table(drafts, stream, "k", "d", "r", S.T9)
    query = table.writeStream.outputMode("complete").format("memory").queryName("edit_tables").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.k, r.pos, r.slot): r.score for r in spark.table("edit_tables").collect()}
    reads = spark.createDataFrame([r for b in batches for r in b], "k long, r string")
    assert got == {(r.k, r.pos, r.slot): r.score for r in edits.native_table(drafts, reads, "k", "d", "r", S.T9).collect()}


def test_simulation(spark):
    base = spark.range(30).select(F.col("id").alias("k"), simulate.random_sequence(F.lit(400), F.col("id")).alias("s"))
    reads = simulate.simulate_reads(base, "k", "s", 3, simulate.Profile(0.02, 0.02, 0.02), seed=1).join(base, "k").collect()
    assert len(reads) == 90 and sorted(map(tuple, simulate.simulate_reads(base, "k", "s", 3, simulate.Profile(0.02, 0.02, 0.02), seed=1).repartition(7).collect())) == sorted((r.k, r.read_idx, r.read) for r in reads)
    rate = sum(distance(r.read, r.s) for r in reads[:12]) / (12 * 400)
    assert 0.035 < rate < 0.075
    exact = base.select("s", simulate.with_errors(F.col("s"), 3, 2, 4, F.col("k")).alias("e")).limit(5).collect()
    assert all(len(r.e) == 402 and 1 <= distance(r.s, r.e) <= 9 for r in exact)
    assert set("".join(r.s for r in base.collect())) == set("ACGT")
    p = simulate.Profile(0.01, 0.02, 0.01)
    assert abs(p.normalised().total - 1) < 1e-12 and p.scaled(2).deletion == 0.04


@pytest.mark.parametrize("model", [None, M.default_model()])
def test_a_drafts_tables_add_up_in_one_place(spark, monkeypatch, model):
    """One row leaves the kernel for a draft, so no cell is shuffled; a draft of several parts gives the same sums and edits."""
    from strandloom.operators import tables

    layout, largest = (S.T16, False) if model is None else (S.T14, True)
    rng = random.Random(5)
    truth = ["".join(rng.choices("ACGT", k=18)) for _ in range(5)]
    drafts = spark.createDataFrame([(k, mutated(rng, t, 2)) for k, t in enumerate(truth)], "k long, d string")
    reads = spark.createDataFrame([(k, mutated(rng, t, 1)) for k, t in enumerate(truth) for _ in range(40)], "k long, r string").join(drafts, "k")
    found = []
    for limit in (2048, 8):
        monkeypatch.setattr(tables, "PART_READS", limit)
        rows, deep = edits.part_tables(reads, ["k"], "d", "r", layout, model=model)
        assert deep == (limit < 40) and (rows.count() == len(truth)) == (limit > 40)
        summed = edits.summed_tables(rows, "k", layout, deep)
        best = edits.best_edits(rows, "k", layout, largest, deep, improving=False)
        want = edits.best_slots(summed.withColumn("score", F.round("score", 6)), "k", largest)
        told = lambda df: sorted((r.k, r.pos, r.slot, round(r.score, 5)) for r in df.collect())
        if model is None:
            assert told(best) == told(want)
        found.append((told(summed), len(told(best))))
    assert [x[:3] for x in found[0][0]] == [x[:3] for x in found[1][0]] and found[0][1] == found[1][1]
    assert [x[3] for x in found[0][0]] == pytest.approx([x[3] for x in found[1][0]], abs=1e-3)


def test_repeated_positions_are_one_window(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 90), (1, 90), (2, 7)], "k int, pos int")
    assert sorted(map(tuple, edits.merge_windows(rows, "k", 10).select("k", "start", "end").collect())) == [(1, -5, 15), (1, 80, 100), (2, -3, 17)]


def test_windows_hold_no_table_in_memory(spark):
    """A task sorts its rows once: no aggregate by island, and about SORT_ROWS rows in each, whatever the table's size."""
    from strandloom.operators import tables

    rows = spark.range(3 * tables.SORT_ROWS).selectExpr("id % 1000 AS k", "id AS pos")
    merged = edits.merge_windows(rows, "k", 10)
    assert "Aggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    assert tables.sortable(rows, "k").rdd.getNumPartitions() == 4 and tables.sortable(rows.union(rows), "k").rdd.getNumPartitions() == 6


def test_pairs_are_dealt_to_all_tasks(spark):
    """The part table is one small file: without dealing one task has all of a kernel's work."""
    from strandloom.plans.queries import QUERIES
    from strandloom.plans.sequences import pairs

    assert pairs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    for name in ("edit_dp_lambda", "affine_global_score", "sample_reads_hmm"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_a_crop_is_folded_once(spark):
    """The filter and the columns that use a cut share one fold."""
    rows = spark.createDataFrame([("t", 0, "r", "ACGT", "====", 0, 1, 3)], "template_id string, chunk_id int, read_id string, seq string, path string, start int, chunk_start int, chunk_end int")
    cut = assembly.sub_reads(rows)
    assert [tuple(r) for r in cut.collect()] == [("t", 0, "r", "CG", "==")]
    assert cut._jdf.queryExecution().executedPlan().toString().count("aggregate(") == 1


def test_reads_are_aligned_by_all_tasks(spark, monkeypatch):
    rows = [(t, "ACGTACGTAC", "ACGTACGAC"[k:], True, True, None, None) for t in range(20) for k in range(3)]
    pairs = spark.createDataFrame(rows, "tid long, draft string, read string, forward boolean, votes boolean, first long, path string").coalesce(1)
    assert polish._realigned(pairs, "tid", 8, None).rdd.getNumPartitions() == 4
    assert polish._contested(pairs, "tid", 8, M.default_model()).rdd.getNumPartitions() == 4


def test_diagonal_path(spark):
    shapes = [(n, m) for n in (0, 1, 7, 23, 24, 50) for m in (0, 1, 6, 23, 25, 61)]
    rows = spark.createDataFrame(shapes, "n int, m int").select("n", "m", S.bootstrap_path(F.col("n"), F.col("m")).alias("p")).collect()
    assert len(rows) == len(shapes) and all(K.diagonal_path(r.n, r.m) == r.p for r in rows)


def test_first_paths_are_found_where_reads_are_dealt(spark, monkeypatch):
    """The path along the diagonal is no expression over a file's few tasks, and pairs of one small file train by all tasks."""
    df = spark.createDataFrame([("ACGTACGTAC", "ACGTACGAC"[k:], k % 2 == 0) for k in range(4)] * 5, "a string, b string, fwd boolean").coalesce(1)
    rows, seen = fit.map_rows, []
    monkeypatch.setattr(fit, "map_rows", lambda pairs, *a: seen.append(pairs) or rows(pairs, *a))
    fit.fit_step(df, "a", "b", {True: M.default_model(), False: M.default_model()}, strand="fwd", radius=4)
    assert seen[0].rdd.getNumPartitions() == 4
    for plan in (seen[0], align.edit_paths(df, "a", "b", 4), align.best_paths(df, "a", "b", radius=4)):
        assert "sequence(" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_task_adds_up_shares(spark, monkeypatch):
    """One row of shares leaves a task for each strand of a batch, whatever its number of reads."""
    df = spark.createDataFrame([("ACGTACGTAC", "ACGTACGAC", k % 2 == 0) for k in range(40)], "a string, b string, fwd boolean").coalesce(1)
    rows, found = fit.map_rows, []
    monkeypatch.setattr(fit, "dealt", lambda pairs, *_: pairs)
    monkeypatch.setattr(fit, "map_rows", lambda *a: found.append(rows(*a)) or found[0])
    fit.fit_step(df, "a", "b", {True: M.default_model(), False: M.default_model()}, strand="fwd")
    assert found[0].count() == 2
