"""Language ID, language-model scores, media columns, packing, mixing and sharding."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandloom.llm import language_id, mixing, packing, pitman_yor, progressive_jpeg, sharding

from . import cases
from .test_dedup import lower, table, words


def test_language_id_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.filter(~F.col("held_out")))
    got = language_id.predict(docs, model, ["doc_id", "held_out", "lang"]).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and {r.held_out for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_cases(spark):
    rows = cases.awkward() + cases.rows(["das ist ein Satz und noch einer"] * 5 + ["this is a sentence and another one"] * 5, range(500, 510))
    docs = table(spark, rows)
    model = language_id.train(docs)
    got = language_id.predict(docs, model, docs.columns).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {*docs.columns, "lang_pred", "score"}
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")), r.text
    long = "ab " * 400_000 + "é"  # cut into pieces without losing n-grams
    counts = Counter()
    for _, bucket in language_id._grams([long]):
        counts.update(bucket.tolist())
    assert sum(counts.values()) == sum(len(long) - n + 1 for n in language_id.ORDERS)
    empty = language_id.train(table(spark, []))
    assert language_id.score_texts(empty, ["abc"])[0] == ["und"]
    assert language_id.predict(table(spark, []), model, ["doc_id"]).collect() == []


@pytest.mark.parametrize("text", ["½", "123 ²", "٣", "", None, " \n", "_-!", "🙂"])
def test_no_letter_no_language(text):
    model = language_id.LanguageModel(["x", "y"], np.zeros((language_id.BUCKETS, 2)), np.log(np.array([0.3, 0.7])))
    assert [x[0] for x in language_id.score_texts(model, [text])] == ["und", 0.0]
    assert language_id.score_texts(model, [f"{text}ª"])[0] == ["y"]  # an ordinal sign is a letter


def test_scores_of_naive_bayes():
    model = language_id.LanguageModel(["x", "y"], np.log(np.random.default_rng(0).dirichlet(np.ones(language_id.BUCKETS), 2).T), np.log(np.array([0.3, 0.7])))
    texts = ["Some text", "", "and more of it", None]
    langs, score = language_id.score_texts(model, texts)
    for t, lang, p in zip(texts, langs, score, strict=True):
        total = model.log_prior.copy()
        for _, bucket in language_id._grams([t]):
            total += model.log_prob[bucket].sum(0)
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert lang == (model.languages[share.argmax()] if t else "und") and abs(p - (share.max() if t else 0)) < 1e-9


def test_pitman_yor(spark):
    rows = cases.awkward()
    got = pitman_yor.score_texts(table(spark, rows)).collect()
    counts = Counter()
    tokens = lambda t: [*words(lower(t)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for r in rows:
        if not held(r[0]):
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for r in rows:
        t = tokens(r[1])
        want[str(r[0])].append((held(r[0]), len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)))
    have = defaultdict(list)
    for r in got:
        assert r.train_tokens == n and r.score < 0 and abs(math.log10(r.perplexity) + r.score / r.n_tokens) < 1e-9
        have[str(r.doc_id)].append((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)))
    assert {k: sorted(x) for k, x in want.items()} == {k: sorted(x) for k, x in have.items()}
    assert pitman_yor.score_texts(table(spark, [])).collect() == []


@pytest.mark.parametrize("text", [None, "", "a", "é" * 300, "x" * 192, "x" * 193, "ÿ\xff\x00" * 900])
def test_jpeg_round_trip(text):
    payload, n = progressive_jpeg.pad(text)
    media = progressive_jpeg.encode(payload, n)
    quick, slow = progressive_jpeg.Decoded(media), progressive_jpeg.Decoded(media, quick=False)
    assert quick.payload() == slow.payload() == (payload, n) and np.array_equal(quick.coefficients, slow.coefficients)
    assert quick.rgb().shape == (quick.height, quick.width, 3)


def test_jpeg_general_scan():
    """Runs of zeros, ends of bands, negative values and newly non-zero coefficients, which our own files never have."""
    bits = lambda s: np.packbits(np.array([int(b) for b in s.replace(" ", "")], np.uint8)).tobytes()
    table = {(2, 0): 0x11, (2, 1): 0x00, (2, 2): 0x02}  # 00: one zero then a value of 1 bit; 01: end; 10: value of 2 bits
    c = np.zeros((2, 64), np.int32)
    # block 0: value -3 at 1, zero at 2, value 1 at 3, end; block 1: end
    progressive_jpeg._slow_scan(bits("10 00 00 1 01 01 111"), c, np.arange(2), 1, 5, 0, 1, [(0, table)])
    assert c[0].tolist()[:6] == [0, -6, 0, 2, 0, 0] and not c[1].any()
    # refinement: in block 0 a new -1 after one zero (k=4), correcting 1 and 3 on the way; then end with no more
    table = {(1, 0): 0x11, (2, 2): 0x00}
    progressive_jpeg._slow_scan(bits("0 0 1 1 10 10 11111"), c, np.arange(2), 1, 5, 1, 0, [(0, table)])
    assert c[0].tolist()[:6] == [0, -7, 0, 3, -1, 0] and not c[1].any()


def test_jpeg_transform():
    rng = np.random.default_rng(2)
    c = rng.normal(size=64)
    square = np.zeros(64)
    square[progressive_jpeg.zigzag()] = c
    square = square.reshape(8, 8)
    scale = lambda u: math.sqrt(0.5) if u == 0 else 1
    want = [sum(scale(u) * scale(v) / 4 * square[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) for y in range(8) for x in range(8)]
    assert np.allclose(c @ progressive_jpeg._inverse_transform(), want, atol=1e-5)
    assert sorted(progressive_jpeg.zigzag().tolist()) == list(range(64)) and progressive_jpeg.zigzag()[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_media_columns(spark):
    rows = cases.awkward()
    media = progressive_jpeg.encode_media(table(spark, rows))
    got = progressive_jpeg.read_back(media).collect()
    want = []
    for r in rows:
        payload, n = progressive_jpeg.pad(r[1])
        stored = progressive_jpeg.encode(payload, n)
        want.append((str(r[0]), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:7]) for r in got) == sorted(want)
    features = defaultdict(set)
    for r in got:
        features[r.payload_sha256, r.n_bytes].add(r.feature)
    assert {len(f) for f in features.values()} == {1}
    tensor = progressive_jpeg.rgb_tensors(media).first()
    assert len(tensor.rgb) == tensor.height * tensor.width * 3
    assert progressive_jpeg.read_back(progressive_jpeg.encode_media(table(spark, []))).collect() == []


def test_packing(spark):
    rows = cases.awkward() + cases.rows(["word " * 3000, "same short text"] * 40, range(3000, 3080)) + cases.rows(["<|endoftext|> 汉字 ١٢ 🙂", "ünï"], [1, 2])
    path = packing.default_vocabulary()
    got = packing.pack(table(spark, rows), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), 512).collect()
    exact = packing.Encoder(path)
    want = Counter()
    for r in rows:
        ids = np.append(exact(r[1] or ""), np.uint32(0))
        for k, (at, n) in enumerate(packing.cut(len(ids), 512)):
            want[str(r[0]), k, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes())] += 1
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 512) + 2
    assert packing.pack(table(spark, []), path).collect() == []


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|> 汉字", "plain <|endoftext> |", " <|endoftext|><|endoftext|>\n", ""])
def test_ids_are_those_of_the_file(spark, text):
    """The vocabulary file's own tokenizer, as it is loaded, decides, added tokens included."""
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert packing.Encoder(path)(text).tolist() == packing.Encoder(path, ranks)(text).tolist() == ids
    got = packing.token_pieces(table(spark, cases.rows([text], [1])), path, ranks, 512).collect()
    assert [(r.length, r.ids_crc32) for r in got] == [(len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))]
    assert ids.count(50256) == text.count("<|endoftext|>")


@pytest.mark.parametrize("seed", range(5))
def test_pack_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(30)}
    used = Counter()
    patterns = packing.plan_patterns(counts, 64)
    for times, pattern in patterns:
        assert sum(pattern) <= 64
        for length in pattern:
            used[length] += times
    assert used == Counter(counts)
    first_fit: list[int] = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        k = next((k for k, room in enumerate(first_fit) if room >= length), None)
        if k is None:
            first_fit.append(64 - length)
        else:
            first_fit[k] -= length
    assert sum(t for t, _ in patterns) <= len(first_fit) + 1


def test_exact_fill():
    left = np.zeros(101, np.int64)
    left[[10, 20, 30, 40]] = 1
    assert packing._fill_exactly(left, 40) == [40] and packing._fill_exactly(left, 70) == [40, 30]
    assert packing._fill_exactly(left, 90) == [40, 30, 20] and packing._fill_exactly(left, 20) == [20]
    assert packing._fill_exactly(left, 85) == [] and left.sum() == 4


@pytest.mark.parametrize("options", [{"target_entropy": 0.97}, {"max_epochs": 1.5}, {"max_epochs": 1.3, "budget": "whole"}])
def test_mixing(spark, options):
    rng = random.Random(1)
    rows = cases.awkward()
    rows += [(10_000 + i, "w " * rng.randrange(1, 80), "en", rng.choice(["big"] * 12 + ["mid"] * 4 + ["low", "x"]), 1, i, "k", "l", "m", "f", "d", "w") for i in range(1500)]
    report = mixing.mix_report(table(spark, rows), **options).collect()
    assert len(report) == len(rows)
    have, drawn, weight = Counter(), Counter(), {}
    for r in report:
        assert r.n_tokens == 0 or r.source is not None
        have[r.source] += r.n_tokens
        drawn[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
    assert sum(have.values()) == sum(len(words(r[1])) for r in rows)
    live = {s: n for s, n in have.items() if n}
    assert abs(sum(weight[s] for s in live) - 1) < 1e-6
    share = np.array([live[s] / sum(live.values()) for s in sorted(live)])
    w = np.array([weight[s] for s in sorted(live)])
    powers = np.polyfit(np.log(share), np.log(w), 1)
    assert np.allclose(np.polyval(powers, np.log(share)), np.log(w), atol=1e-4) and -1e-6 <= powers[0] <= 1 + 1e-6
    if "target_entropy" in options:
        assert -(w * np.log(w)).sum() >= 0.97 * math.log(len(w)) - 1e-6
    else:
        assert max(drawn[s] / live[s] for s in live) <= options["max_epochs"] + 1e-6
    mixed = mixing.mix(table(spark, rows), **options)
    assert mixed.columns == table(spark, rows).columns
    if options.get("budget") == "whole":
        assert min(r.copies for r in report) >= 1
        assert Counter(str(r.doc_id) for r in mixed.collect()) == Counter(k for k, n in ((str(r.doc_id), r.copies) for r in report) for _ in range(n))
    assert mixing.mix_report(table(spark, []), **options).collect() == []
    assert mixing.mix(table(spark, []), **options).collect() == []
    with pytest.raises(ValueError, match="one of"):
        mixing.mix(table(spark, []))


def test_sharding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PAGE_BITS", 3)
    rows = cases.awkward() + cases.rows(["same id, many rows"] * 50, [77_777] * 50)
    limit = 3000
    got = sharding.shard_report(table(spark, rows), limit).collect()
    assert Counter((str(r.doc_id), r.n_bytes) for r in got) == Counter((str(r[0]), len((r[1] or "").encode())) for r in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        bits = f"{int(hashlib.md5(str(r.doc_id if r.doc_id is not None else '').encode()).hexdigest()[:15], 16):060b}"
        assert bits.startswith(r.shard) and len(r.shard) == r.depth
    for bits, own in shards.items():
        total = sum(r.n_bytes for r in own)
        assert {(r.shard_bytes, r.shard_docs) for r in own} == {(total, len(own))}
        assert total <= limit or len({r.doc_id for r in own}) == 1
        parent = [r for b, rs in shards.items() if b.startswith(bits[:-1]) for r in rs]
        assert not bits or sum(r.n_bytes for r in parent) > limit
    one = sharding.shard_report(table(spark, rows), 10**9).collect()
    assert {r.shard for r in one} == {""}
    assert sharding.shard_report(table(spark, []), 10).collect() == []
    sharding.write_shards(table(spark, rows), str(tmp_path / "out"), 10**6)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
