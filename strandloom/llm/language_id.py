"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass: each task sums its n-grams into one vector a language and the vectors are added up by
(language, block of buckets).  The log-probability matrix has a fixed size (buckets x languages) and goes to the
tasks with the scoring function, which scores a batch of texts with gathers and segment sums in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import lean, unused

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
_PIECE = 1 << 18
_VECTOR_BLOCK = 4096
_tables: dict[str, np.ndarray] = {}


@dataclass
class LanguageModel:
    """languages[k] belongs to column k of `log_prob` (buckets x languages) and to entry k of `log_prior`."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of the n-grams of lower-cased texts, a bounded number at a time; other characters count as spaces.

    A text longer than a piece is cut with an overlap, so that each n-gram counts once.
    """
    reach = max(ORDERS) - 1
    held: list[tuple[int, str, int]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(s for _, s, _ in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(_letters()[code], code, 32).astype(np.uint64)
        lengths = np.array([len(s) for _, s, _ in held])
        cores = np.array([c for _, _, c in held])
        row = np.repeat(np.array([r for r, _, _ in held]), lengths)
        place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        room, core = np.repeat(lengths, lengths) - place, place < np.repeat(cores, lengths)
        rows, buckets = [], []
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            shifted = np.zeros(len(code), np.uint64)
            shifted[: len(code) - n + 1] = code[n - 1 :]
            gram = gram * np.uint64(0x10001) + shifted + np.uint64(1)
            if n in ORDERS:
                valid = core & (room >= n)
                hashed = (gram[valid] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
                rows.append(row[valid])
                buckets.append((hashed >> np.uint64(48)).astype(np.int64))
        return np.concatenate(rows), np.concatenate(buckets)

    for r, text in enumerate(texts):
        if not text:
            continue
        low = text.lower()
        for at in range(0, len(low), _PIECE):
            held.append((r, low[at : at + _PIECE + reach], min(_PIECE, len(low) - at)))
            size += len(held[-1][1])
            if size >= _PIECE:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for name in set(lang):
            rows[name] = rows.get(name, 0) + lang.count(name)
        names = sorted(set(lang))
        code = np.array([names.index(x) for x in lang], np.int64)
        for row, bucket in _grams(batch.column(0).to_pylist()):
            got = np.bincount(code[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for k, name in enumerate(names):
                sums[name] = sums.get(name, 0) + got[k]
    out = [(name, b, rows[name] if b == 0 else 0, v[b * _VECTOR_BLOCK : (b + 1) * _VECTOR_BLOCK].astype(np.int64).tobytes()) for name, v in sums.items() for b in range(BUCKETS // _VECTOR_BLOCK)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["lang", "block", "n_docs", "counts"])


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
    return pd.DataFrame({"lang": frame["lang"].iloc[:1], "block": frame["block"].iloc[:1], "n_docs": [frame["n_docs"].sum()], "counts": [total.tobytes()]})


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Count all rows with a language.  What reaches the driver is languages x BUCKETS numbers, whatever the input's size."""
    counted = df.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    schema = "lang string, block long, n_docs long, counts binary"
    sums = counted.mapInArrow(lean(_count), schema).groupBy("lang", "block").applyInPandas(_add_up, schema).collect()
    languages = sorted({r["lang"] for r in sums})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    counts, docs = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    for r in sums:
        k = languages.index(r["lang"])
        counts[r["block"] * _VECTOR_BLOCK : (r["block"] + 1) * _VECTOR_BLOCK, k] = np.frombuffer(r["counts"], np.int64)
        docs[k] += r["n_docs"]
    log_prob = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * BUCKETS)
    return LanguageModel(languages, log_prob, np.log(docs / docs.sum()))


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The most likely language of each text and its posterior; "und" and 0 where a text has no letter."""
    total = np.tile(model.log_prior, (len(texts), 1))
    for row, bucket in _grams(texts):
        starts = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
        np.add.at(total, row[starts], np.add.reduceat(model.log_prob[bucket], starts, axis=0))
    known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    top = total.max(1, keepdims=True) if len(texts) else total
    posterior = 1 / np.exp(total - top).sum(1)
    best = total.argmax(1)
    return [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.minimum(posterior, 1.0), 0.0)


def predict(df: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns of `df` with lang_pred (a learned language or "und") and score (0 to 1) for each row.

    A null or empty text and a text without letters (digits, number signs and marks aren't) get "und" with score 0, and so
    does every text where no language was learnt.  Texts of any length are read whole.  Of languages that tie, the
    first by name is taken.  Repeated rows are predicted alike, and an empty table gives an empty result.  Nothing but
    the text is read for a prediction; columns of `df` named like the result's are replaced, others stay as they are.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    # Kept columns go through as fields k0, k1, ... of one struct: their own names may be anything.
    chosen = df.select(F.struct(F.lit(True).alias("k"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]).alias("kept"), F.col(text_col).alias("text"))
    schema = StructType([chosen.schema[0], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = score_texts(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["kept", "lang_pred", "score"])

    out = chosen.mapInArrow(lean(run), schema)
    return out.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold that training never sees; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
