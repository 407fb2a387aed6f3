"""Embedding whitening by QDWH spectral divide and conquer.

The covariance of all vectors is summed in Spark: exact integer sums first, then centred products, added up by entry.
The driver holds one d x d matrix and splits its space by polar decompositions: the polar factor of the covariance less
a shift has the eigenvalues 1 and -1, so half of it plus one is the projector on the components above the shift.  Each
side is split again until every piece is one component.  The components go to the tasks as one broadcast matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Entries of a vector at most: the driver splits one matrix of so many rows and columns.
MAX_DIMENSION = 2048
#: Rows of a batch that are turned into numbers at once.
ROWS = 4096
SCALE, SHIFT = 64, 1_000_000
#: Vectors whose sums a task adds up as longs before it hands them on (entries are under 2**46 then).
SUMMED = 1 << 16
#: A component whose variance is a smaller part of the largest one's counts as having none: rounding would show in its whitened values.
REAL = 1e-11

_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps, each one QR decomposition."""
    n = len(a)
    norm = np.linalg.norm(a, 2)
    x = a / norm
    low = max(np.linalg.norm(x, -2) * 0.9, _EPS)  # a lower bound of the singular values; it only steers the weights
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root), 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved, x = np.linalg.norm(new - x), new
        if moved < np.cbrt(_EPS) and 1 - low < 10 * _EPS or moved < 10 * n * _EPS:
            break
    return x


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix.

    A piece whose spread is within rounding of the whole matrix is taken as it stands: its directions are equal.
    """
    size = max(np.linalg.norm(v, 2), np.finfo(float).tiny) if len(v) else 1.0
    rng = np.random.Generator(np.random.PCG64(11))
    values, vectors = [], []
    open_pieces = [np.eye(len(v))] if len(v) else []
    while open_pieces:
        basis = open_pieces.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        k = len(a)
        diagonal = np.diag(a)
        if k == 1 or np.linalg.norm(a - np.diag(diagonal), 2) <= 4 * _EPS * size:
            values += list(diagonal)
            vectors += list(basis.T)
            continue
        # All eigenvalues lie within the extremes of a's own; halve the space at the middle of its diagonal, else at their mean.
        for shift in (np.median(diagonal), np.mean(diagonal), (diagonal.max() + diagonal.min()) / 2):
            projector = (polar_factor(a - (shift + 3 * _EPS * size) * np.eye(k)) + np.eye(k)) / 2
            above = round(float(np.trace(projector)))
            if 0 < above < k:
                break
        else:  # the shift sits inside a cluster: take off-centre shifts until one parts it
            spread = np.linalg.norm(a - np.mean(diagonal) * np.eye(k), 2)
            for t in range(1, 40):
                shift = np.mean(diagonal) + spread * (-1) ** t * 2.0 ** -(t // 2 + 1)
                projector = (polar_factor(a - shift * np.eye(k)) + np.eye(k)) / 2
                above = round(float(np.trace(projector)))
                if 0 < above < k:
                    break
            else:
                values += list(diagonal)
                vectors += list(basis.T)
                continue
        q, _ = np.linalg.qr(projector @ rng.standard_normal((k, above)), mode="complete")
        # A second pass takes the range out of the projector with full accuracy.
        q, _ = np.linalg.qr(projector @ q[:, :above], mode="complete")
        open_pieces += [basis @ q[:, above:], basis @ q[:, :above]]
    order = np.argsort(-np.array(values), kind="stable")
    basis = np.array(vectors).T[:, order] if vectors else np.zeros((0, 0))
    return np.array(values)[order] if values else np.zeros(0), basis


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row whether it stays (no null, no entry that is null, not finite or too large), its length, and all entries flat."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    wrong = np.asarray(flat.is_null())
    values = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    wrong = wrong | ~(np.abs(values) < 2.0**40)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(wrong)])
    stays = np.asarray(column.is_valid()) & (lengths > 0) & (bad[ends] == bad[ends - lengths])
    return stays, lengths, values


def _matrices(batches: Iterator[pa.RecordBatch], dim: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches, with the rows that stay and their entries as longs; with `dim` only vectors of that length."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            stays, lengths, values = _vectors(batch.column(0))
            starts = np.cumsum(lengths) - lengths
            for d in [dim] if dim else np.unique(lengths[stays]).tolist():
                rows = np.flatnonzero(stays & (lengths == d))
                if len(rows):
                    yield batch, rows, np.floor(SCALE * values[starts[rows][:, None] + np.arange(d)]).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("d", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("s", pa.int64())])
    found: dict[int, list] = {}

    def handed_on(d: int) -> pa.RecordBatch:
        n, sums = found.pop(d)
        return pa.RecordBatch.from_pydict({"d": [d] * d, "i": range(d), "n": [n] * d, "s": sums}, schema)

    for _, rows, x in _matrices(batches):
        d = x.shape[1]
        own = found.setdefault(d, [0, np.zeros(d, np.int64)])
        own[0] += len(rows)
        own[1] += x.sum(0)
        if own[0] >= SUMMED:
            yield handed_on(d)
    for d in list(found):
        yield handed_on(d)


def _entries(product: np.ndarray) -> pa.RecordBatch:
    """The entries of a square matrix, one row each."""
    k = len(product)
    return pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "v": product.ravel()}, pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())]))


def _summed(entries: DataFrame, k: int) -> np.ndarray:
    """k x k sums on the driver, added up by entry in Spark: k squared numbers, whatever the number of rows."""
    total = np.zeros((k, k))
    for r in entries.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    return total


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S / n as whole parts and rests: taken off one after the other, they lose no digits to the entries' common size."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


class Whitening:
    """What the tasks get: the dimension, n, the sums, the components and their eigenvalues."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int) -> None:
        self.n = n
        self.whole, self.rest = _mean(n, sums)
        self.sums = np.array([s % 2**64 for s in sums], np.uint64).view(np.int64)  # modulo 2**64: differences stay exact
        values, vectors = spectral_components(covariance)
        trace = float(np.trace(covariance))
        self.values, self.vectors = values[:most], np.ascontiguousarray(vectors[:, :most])
        self.explained = self.values / trace if trace > 0 else np.zeros(len(self.values))
        #: Components without variance beyond rounding are projected to 0.
        self.real = self.values > REAL * max(float(values[0]) if len(values) else 0.0, 0.0)
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, self.values, 1.0)), 0.0)
        return self.centred(x) @ self.vectors * scale


def _deviation(x: np.ndarray, fit: Whitening) -> pa.Array:
    """sum of (n x - S) squared, exact; null where it doesn't fit a long.  Differences are exact even if n x wraps around."""
    off = x * np.int64(fit.n) - fit.sums
    about = ((fit.centred(x) * fit.n) ** 2).sum(1)
    fits = about < 9.2e18
    return pa.array((np.where(fits[:, None], off, 0) ** 2).sum(1), pa.int64(), mask=~fits)


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all vectors that stay; None where none does.  Three passes over the vectors, d squared numbers to the driver."""
    spark = df.sparkSession
    vectors = df.select(F.col(vector_col).alias("v"))
    sums = vectors.mapInArrow(lean(_sums), "d long, i long, n long, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    common = sums.filter("i = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not common:
        return None
    dim, n = common[0]["d"], common[0]["n"]
    if dim > MAX_DIMENSION:
        raise ValueError(f"vectors of {dim} entries; at most {MAX_DIMENSION} can be whitened")
    total = [int(r["s"]) for r in sums.filter(F.col("d") == dim).orderBy("i").collect()]
    mean = spark.sparkContext.broadcast(_mean(n, total))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = mean.value
        gram = None
        for _, _, x in _matrices(batches, dim):
            c = (x - whole).astype(float) - rest
            gram = c.T @ c if gram is None else gram + c.T @ c
        if gram is not None:
            yield _entries(gram)

    entry = "i long, j long, v double"
    covariance = _summed(vectors.mapInArrow(lean(products), entry), dim) / n
    fit = Whitening(n, total, (covariance + covariance.T) / 2, components)
    shared = spark.sparkContext.broadcast(fit)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = None
        for _, _, x in _matrices(batches, dim):
            w = np.hstack([shared.value.whitened(x), np.ones((len(x), 1))])  # the last row of the product sums the whitened values
            gram = w.T @ w if gram is None else gram + w.T @ w
        if gram is not None:
            yield _entries(gram)

    k = len(fit.values)
    products_again = _summed(vectors.mapInArrow(lean(again), entry), k + 1) / n
    off = products_again[:k, :k] - np.outer(products_again[k, :k], products_again[k, :k]) - np.diag(fit.real.astype(float))
    fit.identity_error = float(np.abs(off).max()) if k else 0.0
    return fit


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that stays and component.

    Vectors that are null or empty, or hold an entry that is null, not finite or 2**40 or more in size, are dropped, as are
    those of another length than most have (of lengths that tie the greater counts).  Entries are taken as floor(64 c) + 1000000.
    Components are numbered from 1 by falling eigenvalue; of `components` a dimension of d entries has d at most.  One
    without variance (beyond rounding) has the whitened value 0 and is left out of identity_error's identity.  `deviation` is
    null where it doesn't fit a long.  Ids may be null or repeat: rows are whitened alike.  An empty table gives no rows,
    other columns are ignored.
    """
    fit = fit_whitening(df, vector_col, components)
    rows = df.select(F.col(vector_col).alias("v"), F.col(id_col).cast("long").alias("id"))
    if fit is None:
        return df.sparkSession.createDataFrame([], _RESULT)
    shared = df.sparkSession.sparkContext.broadcast(fit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        for batch, kept, x in _matrices(batches, len(model.sums)):
            m = len(kept)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(kept)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), _deviation(x, model).take(each),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(lean(project), _RESULT)


def whitened_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """The whitened vectors themselves, one row a vector: vec_id and an array of `components` values, in the order of rows of `whiten`."""
    fit = fit_whitening(df, vector_col, components)
    if fit is None:
        return df.sparkSession.createDataFrame([], "vec_id long, whitened array<double>")
    shared = df.sparkSession.sparkContext.broadcast(fit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        for batch, kept, x in _matrices(batches, len(model.sums)):
            offsets = pa.array(np.arange(0, (len(kept) + 1) * k, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(kept)), pa.ListArray.from_arrays(offsets, pa.array(model.whitened(x).ravel()))], names=["vec_id", "whitened"])

    return df.select(F.col(vector_col).alias("v"), F.col(id_col).cast("long").alias("id")).mapInArrow(lean(project), "vec_id long, whitened array<double>")
