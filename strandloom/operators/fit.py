"""Re-estimation of pair-HMM models from (reference, query) pairs, one or many templates, one or both strands.

An iteration is one job: each task runs forward and backward over its reads and adds up their 41 expected shares, those
sums are added up in Spark, and only the sums of each strand reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.model import PRIOR
from .align import _inputs, _placed
from .kernels_on_rows import CELLS, by_shape, map_rows
from .tables import dealt

_SHARES = 9 + 16 + 16


def fit_step(pairs: DataFrame, reference: str, query: str, models: dict[bool, K.PairModel], strand: str | None = None, radius: int | None = None, path: str | None = None) -> dict[bool, K.PairModel]:
    """One iteration.  `models` has a model for each value of the `strand` column (True: forward; only True without one).

    Reads whose likelihood isn't finite, or differs between forward and backward, don't count.  A strand without
    reads keeps its model.
    """
    source = dealt(pairs.withColumn("__strand", F.coalesce(F.col(strand), F.lit(True)) if strand else F.lit(True)), reference, query)

    def kernel(frame: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        rows: list[int] = []
        shares: list[np.ndarray] = []  # added up, of each strand
        for forward, own in frame.groupby(frame.columns[-1]):
            sums = np.zeros(_SHARES)
            for places, x, y, band in by_shape(_placed(own.reset_index(drop=True), radius, path), radius, CELLS // 4):
                found = models[bool(forward)].expected(x, y, band)
                sums += found[np.isfinite(found).all(-1)].sum(0)
            if sums.any():
                rows.append(int(own.index[0]))
                shares.append(sums)
        return np.array(rows, int), pd.DataFrame({"shares": pd.Series(shares, dtype=object)})

    shares = map_rows(source, ["__strand"], [*_inputs(reference, query, path), "__strand"], "shares array<double>", kernel)
    sums = shares.groupBy("__strand").agg(*[F.sum(F.col("shares")[k]).alias(f"s{k}") for k in range(_SHARES)]).collect()
    out = dict(models)
    for row in sums:
        out[row["__strand"]] = _normalised(np.array([row[f"s{k}"] for k in range(_SHARES)]))
    return out


def _normalised(sums: np.ndarray) -> K.PairModel:
    """A model from summed shares, with a uniform prior on every number; first bases are uniform."""
    rows = [x.reshape(-1, n) + PRIOR for x, n in ((sums[:9], 3), (sums[9:25], 4), (sums[25:], 4))]
    move, emit, insert = (x / x.sum(1, keepdims=True) for x in rows)
    return K.PairModel(move, emit, np.concatenate([insert, np.full((1, 4), 0.25)]))


def fit(pairs: DataFrame, reference: str, query: str, models: dict[bool, K.PairModel], rounds: int, **options) -> dict[bool, K.PairModel]:
    for _ in range(rounds):
        models = fit_step(pairs, reference, query, models, **options)
    return models
