"""The pipeline end to end and its stages' decisions."""

from collections import Counter

import corpus_pipeline
from strandloom.llm import common
from strandloom.llm.common import materialise, passing
from strandloom.llm.language_id import predict, train

from . import cases
from .test_dedup import lower, table


def test_stages(spark):
    rows = [r for r in cases.awkward() if r[0] is not None]
    docs = table(spark, rows)
    language, exact, near, mixing, packing = (f for _, f in corpus_pipeline.STAGES)
    kept = materialise(language(spark, docs, ""))
    assert kept.columns == docs.columns
    letters = [r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert not Counter(r.text for r in kept.collect()) - Counter(letters) and kept.count() >= 0.9 * len(letters)
    found = {r.doc_id: r for r in predict(docs, train(docs), ["doc_id", "text"]).collect()}
    assert {r.lang for r in kept.collect()} <= {"en", "de"} and all(r.lang is not None for r in kept.collect())
    assert all(found[r.doc_id].score >= corpus_pipeline.MIN_SCORE or found[r.doc_id].text != r.text for r in kept.collect())
    once = materialise(exact(spark, kept, ""))
    texts = [lower(r.text) for r in once.collect()]
    assert once.columns == docs.columns and sorted(texts) == sorted({lower(r.text) for r in kept.collect()})
    apart = materialise(near(spark, once, ""))
    assert apart.columns == docs.columns and 0 < apart.count() <= once.count()
    mixed = materialise(mixing(spark, apart, ""))
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} == {r.text for r in apart.collect()}
    packed = packing(spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and {r.length for r in got} and max(r.offset + r.length for r in got) <= 2048


def test_language_decides(spark):
    texts = ["der die das und nicht ist ein Haus", "the house is not there and it was a house", "le la les une est dans maison"] * 4
    rows = [(i, t, "de fr en".split()[[0, 2, 1][i % 3]] if i < 9 else None) for i, t in enumerate(texts)]
    rows += [(100, "½ ² 12", "de"), (101, None, None), (102, "qq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept[9] == "de" and kept[10] == "en" and kept[11] == "fr" and not {100, 101} & kept.keys()
    score = {r.doc_id: r.score for r in predict(docs, train(docs), ["doc_id"]).collect()}
    assert (102 in kept) == (score[102] >= corpus_pipeline.MIN_SCORE)
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, unlabelled, "").collect()} == {*range(12), 102}


def test_every_stage_takes_null_ids_clashing_columns_and_no_rows(spark):
    clashes = ["__text", "__source", "__block", "__rank", "__copies", "row", "block", "id", "sha", "score", "component_id", "shard", "kept_text"]
    rows = [(*r, *[f"{c}{k}" for c in clashes]) for k, r in enumerate(cases.awkward())]
    schema = f"{cases.SCHEMA}, " + ", ".join(f"{c} string" for c in clashes)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        found = materialise(stage(spark, docs, ""))
        none = stage(spark, docs.limit(0), "")
        assert found.count() > 0 and none.count() == 0, name
        if name != "packing":
            assert found.columns == docs.columns == none.columns, name
            held = {r[-1] for r in rows}
            assert {r["kept_text"] for r in found.collect()} <= held, name


def test_tables_between_stages_go(spark, monkeypatch, tmp_path):
    """On the shared folder are the last stage's input and what packing writes; an earlier stage's result takes no space any more."""
    rows = [(k, f"{chr(97 + k % 26)} word {k} and the rest " * 200, "en", "web") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    seen = []
    same = lambda s, d, _: seen.append(size()) or d
    monkeypatch.setattr(corpus_pipeline, "documents", lambda *_: docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), same) for k in range(5)])
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, "").collect()) == list(range(300))
    assert seen[0] == 0 < seen[1] and all(s < 1.5 * seen[1] for s in seen[2:])
    with passing(spark) as keep:
        inner = materialise(docs)
        kept = keep(inner)
    assert kept.count() == 300 and not any(s > 1000 for s in (p.stat().st_size for p in tmp_path.rglob(f"{inner.inputFiles()[0].split('/')[-2]}/*")))
