"""Language-model scoring with a hierarchical Pitman-Yor model of words in contexts.

Restaurants: one for each context, which is the word before (or the start of the text), all sharing the root restaurant
as parent, whose base is uniform over the known words and the unknown one.

Seating is sampled by Gibbs, all customers of one dish in one restaurant at a time: given the other dishes' tables and
the parent's probability of the dish, both without the dish's own share, the number of its tables is drawn from its
exact conditional distribution (generalised Stirling numbers; see `seat` for dishes of very many customers).  All
dishes of a sweep are drawn at once from the totals of the sweep before, which is Gibbs sampling in parallel blocks.
Random numbers are hashes of (dish, sweep), so a draw can be repeated anywhere.  Before the first sweep every customer
has a table of their own.  Predictive probabilities are averaged over the sweeps after the burn-in.

Dataflow: texts are packed into slices of bounded size.  Each slice asks, by hash range, for the corpus counts of its
pairs and words; the first slice that asks for a pair is its owner.  In a sweep every slice draws the tables of its own
pairs, keeps them for the sweeps and the scoring that follow, and asks with each word's sums of tables for the corpus
sums.  Whatever is asked for meets in ranges of bounded size, to which a slice sends one row each, however frequent a
word is.  The driver sees two sums a sweep.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, give_back, lean, materialise, mix, row_chunks, runs_of, shared_dir, text_buffer, words

SLICE_BYTES = 10 << 20
#: Up to this many customers of a dish the number of tables is drawn exactly.
EXACT = 400
_TOKENS_AT_ONCE = 500_000
_U = np.uint64
_END = _U(0x1D8E4E27C47D1240)
_START = _U(0x5B2C90D76F1A8E33)
#: Kinds of rows; those of later sweeps' words count on from _WORDS, and a slice's own tables after sweep k are of kind -k.
_PAIRS, _WORDS = 0, 1
_ASKED = "kind int, bucket long, slice long, n long, keys binary, sums binary"
_TOLD = "slice long, kind int, bucket long, n long, told binary, first long, second long"


@dataclass
class Model:
    """Discounts and strengths, corpus totals, and customers and tables of the root before the first and after each sweep."""

    discount: float = 0.75
    strength: float = 20.0
    root_discount: float = 0.65
    root_strength: float = 20.0
    burn_in: int = 1
    tokens: int = 0
    vocabulary: int = 0
    root_customers: list[int] = field(default_factory=list)
    root_tables: list[int] = field(default_factory=list)

    def root_of(self, sweep: int, word: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """Tables of each word in the root after a sweep, given its customers there."""
        if sweep == 0:
            return np.minimum(customers, 1)
        return seat(customers, 1 / (self.vocabulary + 1), self.root_tables[sweep - 1] - 1.0, self.root_discount, self.root_strength, mix(word + _salt(sweep)))

    def root_probability(self, sweep: int, customers: np.ndarray, tables: np.ndarray, without: np.ndarray | int = 0) -> np.ndarray:
        """Of words with these customers and tables in the root, `without` so many of their customers."""
        rest = customers - without
        kept = np.minimum(tables, rest)
        total = self.root_strength + self.root_customers[sweep] - without
        return (rest - self.root_discount * kept + (self.root_strength + self.root_discount * (self.root_tables[sweep] - tables + kept)) / (self.vocabulary + 1)) / total


def _salt(sweep: int) -> np.uint64:
    return _U(sweep * 0xD1342543DE82EF95 % (1 << 64))


@cache
def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers: ways to seat n customers at t tables, by n and t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore"):
        for n in range(EXACT):
            out[n + 1] = out[n] + np.log(np.maximum(n - discount * t, 0) if n else np.zeros(EXACT + 1))
            out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
    return out


def seat(customers: np.ndarray, parent: np.ndarray | float, others: np.ndarray | float, discount: float, strength: float, seed: np.ndarray) -> np.ndarray:
    """Tables of dishes with so many customers, given the parent's probability and the tables of the restaurant's other dishes.

    Up to EXACT customers the number is drawn from its distribution, Stirling number x product of (strength + discount x
    tables) x parent ^ tables.  Of more it is normal with the mean and variance of the same distribution's saddle point:
    tables' sizes have the generating function (1 - (1 - x) ^ discount) / discount, and their sum is given.
    """
    n = np.asarray(customers, np.int64)
    parent, others = np.broadcast_to(np.asarray(parent, float), n.shape), np.broadcast_to(np.asarray(others, float), n.shape)
    tables = np.minimum(n, 1)
    order = np.argsort(n, kind="stable")
    many = order[np.searchsorted(n[order], 2) : np.searchsorted(n[order], EXACT, "right")]
    exact = n[many]
    starts = runs_of(exact)
    ways = _stirling(discount)
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        c = int(exact[lo])
        t = np.arange(c)
        for at in range(lo, hi, max(1, 1_000_000 // c)):
            some = many[at : min(hi, at + max(1, 1_000_000 // c))]
            weight = np.log(strength + discount * (np.maximum(others[some], 0)[:, None] + t))
            weight += np.log(parent[some])[:, None]
            np.cumsum(weight, axis=1, out=weight)
            weight += ways[c, 1 : c + 1]
            weight -= weight.max(1, keepdims=True)
            np.exp(weight, out=weight)
            np.cumsum(weight, axis=1, out=weight)
            draw = (mix(seed[some]) >> _U(11)) * 2.0**-53 * weight[:, -1]
            tables[some] = np.minimum((weight <= draw[:, None]).sum(1) + 1, c)
    large = np.flatnonzero(n > EXACT)
    if len(large):
        c, t = n[large].astype(float), np.ones(len(large))
        for _ in range(20):  # new tables make further ones likelier
            fresh = (strength + discount * (np.maximum(others[large], 0) + t)) * parent[large]
            low, high = np.zeros(len(large)), np.ones(len(large))  # y = 1 - x with c y ^ (1 - discount) = fresh (1 - y)
            for _ in range(60):
                y = (low + high) / 2
                under = c * y ** (1 - discount) < fresh * (1 - y)
                low, high = np.where(under, y, low), np.where(under, high, y)
            t = 1 + fresh * (1 - high**discount) / discount
        u, v = ((mix(seed[large] + _U(k)) >> _U(11)) * 2.0**-53 for k in (1, 2))
        normal = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)
        spread = t - 1 - c / (1 + (1 - high) * (1 - discount) / high)
        tables[large] = np.clip(np.rint(t + np.sqrt(np.maximum(spread, 0)) * normal), 1, c)
    return tables


def _slices(slice_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack rows (doc_id, held_out, text) into rows (slice, packed) of about `slice_bytes` of text, compressed."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    size = made = 0
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))

    def pack() -> pa.RecordBatch:
        nonlocal made, size
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as writer:
            writer.write_table(pa.Table.from_batches(held).combine_chunks())
        made += 1
        held.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "packed"])

    for batch in batches:
        _, offsets = text_buffer(batch.column(2))
        for i, j in row_chunks(offsets, max(1, slice_bytes // 4)):
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
            if size >= slice_bytes:
                yield pack()
    if held:
        yield pack()


class _Slice:
    """A slice's rows, tokens, and its distinct words (with the start) and pairs, both sorted by hash."""

    def __init__(self, packed: bytes):
        table = pa.ipc.open_stream(packed).read_all()
        data, offsets = text_buffer(table.column("text"))
        tokens, sizes = [], [np.zeros(1, np.int64)]
        for i, j in row_chunks(offsets):
            _, _, row, h = words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
            n = np.bincount(row, minlength=j - i) + 1
            ends = np.cumsum(n)
            token = np.full(int(ends[-1]), _END)
            inside = np.ones(len(token), bool)
            inside[ends - 1] = False
            token[inside] = h
            tokens.append(token)
            sizes.append(n)
        self.rows = table.select(["doc_id", "held_out"])
        self.at = np.cumsum(np.concatenate(sizes))
        token = np.concatenate(tokens)
        del data, offsets, tokens, table
        self.word, token = np.unique(np.append(token, _START), return_inverse=True)
        self.token = token[:-1].astype(np.int32)
        before = np.empty(len(self.token), np.int32)
        before[1:] = self.token[:-1]
        before[self.at[:-1]] = token[-1]
        key = mix(mix(self.word)[before] + self.word[self.token])
        order = np.argsort(key)
        starts = runs_of(key[order])
        self.pair = key[order[starts[:-1]]]
        self.of = np.empty(len(key), np.int32)  # the pair of each token
        self.of[order] = np.repeat(np.arange(len(self.pair), dtype=np.int32), np.diff(starts))
        self.context, self.dish = before[order[starts[:-1]]], self.token[order[starts[:-1]]]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows that are learnt from: how often each pair occurs, and each word; the start counts their rows."""
        learnt = ~np.asarray(self.rows.column("held_out").combine_chunks()).astype(bool)
        training = np.repeat(learnt, np.diff(self.at))
        of_word = np.bincount(self.token[training], minlength=len(self.word))
        of_word[np.searchsorted(self.word, _START)] = learnt.sum()
        return np.bincount(self.of[training], minlength=len(self.pair)), of_word


def _squeezed(numbers: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers, "<i8").tobytes(), "zstd", asbytes=True)


def _numbers(squeezed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(squeezed, 8 * n, "zstd", asbytes=True), "<i8")


def _ask(kind: int, one: int, keys: np.ndarray, sums: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row for each hash range with keys: the first of the sorted keys, steps of as few bytes as hold them, and their numbers."""
    bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    starts = runs_of(bucket)
    packed, told = [], []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        steps = np.diff(keys[lo:hi])
        width = -(-int(steps.max()).bit_length() // 8) if len(steps) else 0
        packed.append(keys[lo].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        told.append(_squeezed(np.concatenate([s[lo:hi] for s in sums])))
    n = len(packed)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(bucket[starts[:-1]]), pa.array(np.full(n, one, np.int64)), pa.array(np.diff(starts)), pa.array(packed, pa.binary()), pa.array(told, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "slice", "n", "keys", "sums"])


def _kept(sweep: int, one: int, tables: np.ndarray) -> pa.RecordBatch:
    """A row with a slice's own tables after a sweep, which comes back to the slice as it is."""
    values = [-sweep, one, one, len(tables), b"", _squeezed(tables)]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = [pa.array([v] if len(tables) else [], t) for v, t in zip(values, types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "slice", "n", "keys", "sums"])


def _keys(packed: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    data = np.frombuffer(packed, np.uint8)
    steps[0] = data[:8]
    if n > 1:
        steps[1:, : (len(data) - 8) // (n - 1)] = data[8:].reshape(n - 1, -1)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _first_requests(pair_buckets: int, word_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _Slice(packed.as_py())
                of_pair, of_word = own.counts()
                yield _ask(_PAIRS, one, own.pair, [of_pair], pair_buckets)
                yield _ask(_WORDS, one, own.word, [of_word], word_buckets)

    return run


def _answer(model: Model, sweep: int):
    """Sums of all slices' numbers by key, told to each slice in its order of keys.

    Pairs: twice the count, and 1 more for the owner.  After a sweep the words' root tables come as well.  first and second are the totals of the range: at first tokens and
    words learnt from, then customers and tables of the root.  A slice's own tables are passed on.
    """
    schema = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("told", pa.binary()), ("first", pa.int64()), ("second", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("slice")
        kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
        if kind < 0:
            none = pa.array(np.zeros(rows.num_rows, np.int64))
            return pa.Table.from_arrays([*(rows.column(c).combine_chunks() for c in ("slice", "kind", "bucket", "n", "sums")), none, none], schema=schema)
        sizes = rows.column("n").to_numpy()
        at = np.concatenate([[0], np.cumsum(sizes)])
        keys = np.concatenate([_keys(k.as_py(), n) for k, n in zip(rows.column("keys"), sizes.tolist(), strict=True)])
        order = np.argsort(keys, kind="stable")
        starts = runs_of(keys[order])
        word = keys[order[starts[:-1]]]
        wide = 1 if sweep == 0 else 2
        blobs = [_numbers(s.as_py(), wide * n) for s, n in zip(rows.column("sums"), sizes.tolist(), strict=True)]
        sums, told = [], []
        for k in range(wide):
            sums.append(np.add.reduceat(np.concatenate([b[k * n : (k + 1) * n] for b, n in zip(blobs, sizes.tolist(), strict=True)])[order], starts[:-1]))
            whole = np.empty(len(keys), np.int64)
            whole[order] = np.repeat(sums[k], np.diff(starts))
            told.append(whole)
        first = second = 0
        if kind == _PAIRS:
            told[0] *= 2
            told[0][order[starts[:-1]]] += 1
        elif sweep == 0:
            known = sums[0] * (word != _START)
            first, second = int(known.sum()), int((known > 0).sum())
        else:
            root = model.root_of(sweep, word, sums[0])
            first, second = int(sums[0].sum()), int(root.sum())
            whole = np.empty(len(keys), np.int64)
            whole[order] = np.repeat(root, np.diff(starts))
            told.append(whole)
        n = len(sizes)
        edges = zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
        columns = [rows.column("slice").combine_chunks(), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket)), pa.array(sizes), pa.array([_squeezed(np.concatenate([t[lo:hi] for t in told])) for lo, hi in edges], pa.binary())]
        totals = [pa.array([x, *[0] * (n - 1)], pa.int64()) for x in (first, second)]
        out = pa.Table.from_arrays([*columns, *totals], schema=schema)
        give_back()
        return out

    return run


class _State:
    """A slice and what it was told: counts of pairs, words and contexts, and the sums of each sweep so far."""

    def __init__(self, model: Model, slices: pa.Table, told: pa.Table):
        self.model = model
        self.own = own = _Slice(slices.column("packed")[0].as_py())
        told = told.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kind = told.column("kind").to_numpy()
        sizes, blobs = told.column("n").to_pylist(), told.column("told")

        def gathered(k: int, n: int, wide: int) -> np.ndarray:
            """In the slice's order of keys, since ranges are in the order of keys too."""
            parts = [_numbers(blobs[i].as_py(), wide * sizes[i]).reshape(wide, -1) for i in np.flatnonzero(kind == k).tolist()]
            found = np.concatenate(parts, axis=1) if parts else np.zeros((wide, 0), np.int64)
            if found.shape[1] != n:
                raise ValueError(f"slice {slices.column('slice')[0]} asked for {n} keys and was told {found.shape[1]}")
            return found

        pairs = gathered(_PAIRS, len(own.pair), 1)[0]
        self.count, self.owned = pairs >> 1, (pairs & 1).astype(bool)
        of_word = gathered(_WORDS, len(own.word), 1)[0].copy()
        self.customers = np.where(own.word == _END, 0, of_word)  # of each word as a context
        of_word[own.word == _START] = 0
        self.of_word = of_word
        #: Root customers of each word, tables of each context and root tables of each word, before the first and after each sweep.
        self.sums = [(of_word, self.customers, model.root_of(0, own.word, of_word))]
        self.sums += [tuple(gathered(_WORDS + k, len(own.word), 3)) for k in range(1, len(model.root_tables))]
        self.trained = np.flatnonzero(self.count > 0)
        self.seed = own.pair[self.trained]
        self.repeated = np.flatnonzero(self.count[self.trained] > 1)  # a single customer has one table
        #: Tables of the repeated pairs after each sweep that drew them before.
        self.drawn = [gathered(-k, len(self.repeated), 1)[0] for k in range(1, len(model.root_tables))]

    def tables(self) -> Iterator[np.ndarray]:
        """Tables of the trained pairs before the first sweep and after each one."""
        model, own = self.model, self.own
        n, repeated = self.count[self.trained], self.repeated
        c, d = (x[self.trained[repeated]] for x in (own.context, own.dish))
        tables = n.copy()
        yield tables
        for sweep, (of_root, of_context, root) in enumerate(self.sums):
            old = tables[repeated]
            tables = np.ones(len(n), np.int64)
            if sweep < len(self.drawn):
                tables[repeated] = self.drawn[sweep]
            else:
                parent = model.root_probability(sweep, of_root[d], root[d], old)
                tables[repeated] = seat(n[repeated], parent, of_context[c] - old, model.discount, model.strength, self.seed[repeated] + _salt(sweep + 1))
            yield tables


def _sweep(model: Model, buckets: int):
    """Of each slice: the sums of the tables it owns, by word and by context, after one more sweep, and its own tables."""

    def run(slices: pa.Table, told: pa.Table) -> pa.Table:
        if not slices.num_rows:
            return pa.Table.from_batches([], schema=_ask(0, 0, np.zeros(0, np.uint64), [], 1).schema)
        state = _State(model, slices, told)
        own = state.own
        *_, tables = state.tables()
        mine = np.flatnonzero(state.owned[state.trained])
        t, pairs = tables[mine], state.trained[mine]
        sums = [np.bincount(of[pairs], t, len(own.word)).astype(np.int64) for of in (own.dish, own.context)]
        sweep, one = len(model.root_tables), slices.column("slice")[0].as_py()
        out = pa.Table.from_batches([_ask(_WORDS + sweep, one, own.word, sums, buckets), _kept(sweep, one, tables[state.repeated])])
        del state, own
        give_back()
        return out

    return run


def _score(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def run(slices: pa.Table, told: pa.Table) -> pa.Table:
        if not slices.num_rows:
            return schema.empty_table()
        state = _State(model, slices, told)
        own = state.own
        chance, kept = np.zeros(len(own.pair)), 0
        total = model.strength + state.customers[own.context]
        sweeps = len(state.sums)
        for sweep, tables in zip(range(sweeps), state.tables(), strict=False):
            if sweep < min(model.burn_in, sweeps - 1):
                continue
            of_root, of_context, root = state.sums[sweep]
            parent = model.root_probability(sweep, of_root, root)
            chance += (model.strength + model.discount * of_context[own.context]) * parent[own.dish]
            chance[state.trained] += state.count[state.trained] - model.discount * tables
            kept += 1
        log_chance = np.log10(chance / (kept * total))
        known = state.of_word > 0
        base_of = np.log10((state.of_word + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
        at, size = own.at, np.diff(own.at)
        score, base, n_known = np.empty(len(size)), np.empty(len(size)), np.empty(len(size), np.int64)
        for i, j in row_chunks(at, _TOKENS_AT_ONCE):
            first, here = at[i:j] - at[i], slice(at[i], at[j])
            score[i:j] = np.add.reduceat(log_chance[own.of[here]], first)
            base[i:j] = np.add.reduceat(base_of[own.token[here]], first)
            n_known[i:j] = np.add.reduceat(known[own.token[here]].astype(np.int64), first)
        columns = [own.rows.column("doc_id"), own.rows.column("held_out"), size, n_known, np.full(len(size), model.tokens), base, score, 10 ** np.minimum(-score / size, 300)]
        out = pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
        del state, own
        give_back()
        return out

    return run


def _stored_by_slice(slices: DataFrame) -> DataFrame:
    """Slices on the shared folder, bucketed by slice, so that no later look at the texts shuffles them.  There are more buckets
    than tasks that wrote them, so that few hold many slices."""
    spark = slices.sparkSession
    name = f"slices_{uuid.uuid4().hex}"
    slices.write.bucketBy(max(1, 4 * slices.rdd.getNumPartitions()), "slice").option("path", f"{shared_dir(spark)}/strandloom/{name}").saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # noqa: B018 - resolves the table before its name goes
    spark.sql(f"DROP TABLE {name}")  # the name only: a table with a path of its own keeps its files
    return stored


def held_out(id_col: str = "doc_id", folds: int = 10, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold that isn't learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def score_texts(df: DataFrame, n_sweeps: int = 2, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row for each row of `df`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of the whole text with its end; perplexity is that of a token under the model.  A
    null text counts as empty: its only token is the end.  A text of any length is one row of one slice.  Null ids are
    learnt from; repeated rows are learnt from and scored each time.  Where nothing is learnt from, every word is the
    unknown one.  An empty table gives an empty result; other columns are ignored.
    """
    model = model or Model()
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slices = _stored_by_slice(texts.mapInArrow(lean(partial(_slices, slice_bytes)), "slice long, packed binary"))
    n_slices = slices.count()
    pair_buckets, word_buckets = max(1, n_slices // 2), max(1, n_slices // 6)

    def answered(asked: DataFrame, sweep: int) -> tuple[DataFrame, int, int]:
        told = materialise(asked.groupBy("kind", "bucket").applyInArrow(_answer(model, sweep), _TOLD))
        first, second = told.agg(F.sum("first"), F.sum("second")).first()
        return told.select("slice", "kind", "bucket", "n", "told"), int(first or 0), int(second or 0)

    told, model.tokens, model.vocabulary = answered(slices.mapInArrow(lean(_first_requests(pair_buckets, word_buckets)), _ASKED), 0)
    model.root_customers, model.root_tables = [model.tokens], [model.vocabulary]
    by_slice = slices.groupBy("slice")
    for sweep in range(1, n_sweeps + 1):
        more, customers, tables = answered(by_slice.cogroup(told.groupBy("slice")).applyInArrow(_sweep(model, word_buckets), _ASKED), sweep)
        told = told.unionByName(more)
        model.root_customers.append(customers)
        model.root_tables.append(tables)
    return by_slice.cogroup(told.groupBy("slice")).applyInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
