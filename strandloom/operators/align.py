"""Pairwise alignment of rows (reference, query): edit distance, affine gaps, and the pair-HMM.

All of them add columns to a DataFrame and need no shuffle.  `band` is a radius around the path in a column (`path`),
or around the diagonal where there is no such column; None computes the whole table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.model import default_model
from .kernels_on_rows import along_diagonal, by_shape, map_rows, padded


def _inputs(reference: str, query: str, path: str | None) -> list[str]:
    return [reference, query, *([path] if path else [])]


def _placed(frame: pd.DataFrame, radius: int | None, path: str | None) -> pd.DataFrame:
    """The frame with a path in column 2 wherever a band follows one: the diagonal's where the caller names no column."""
    return frame if path or radius is None else along_diagonal(frame)


def edit_paths(df: DataFrame, reference: str, query: str, radius: int | None = None, path: str | None = None, ties: str = "DI=") -> DataFrame:
    """Adds distance and ops: an edit path of least distance (within the band)."""
    def kernel(frame: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        distances: list[int | None] = [None] * len(frame)
        paths: list[str | None] = [None] * len(frame)
        for places, x, y, band, pads in padded(_placed(frame, radius, path), radius):
            tables = K.distance_table(x, y, band)
            before = np.array(pads)
            for k, (p, found) in enumerate(zip(places.tolist(), K.distance_paths(tables, x, y, ties, band.starts, before, before), strict=True)):
                distances[p], paths[p] = int(tables[k, -1, -1]), found
        return np.arange(len(frame)), pd.DataFrame({"distance": pd.array(distances, "Int64"), "ops": pd.Series(paths, dtype=object)})

    return map_rows(df, df.columns, _inputs(reference, query, path), "distance long, ops string", kernel)


def affine_paths(df: DataFrame, reference: str, query: str, scores: tuple[int, int, int, int], mode: str = "global", radius: int | None = None, path: str | None = None) -> DataFrame:
    """Adds score, ref_start, ref_end, query_start, query_end and ops; modes: global, local, infix, overlap."""
    names = ["score", "ref_start", "ref_end", "query_start", "query_end", "ops"]

    def kernel(frame: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        out: list[tuple] = [(None,) * 6] * len(frame)
        for places, x, y, band in by_shape(_placed(frame, radius, path), radius):
            for p, found in zip(places.tolist(), K.affine_pairs(x, y, scores, mode, band), strict=True):
                out[p] = found
        return np.arange(len(frame)), pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=object) for k, c in enumerate(names)})

    return map_rows(df, df.columns, _inputs(reference, query, path), "score long, ref_start long, ref_end long, query_start long, query_end long, ops string", kernel)


def likelihoods(df: DataFrame, reference: str, query: str, model: K.PairModel | None = None, radius: int | None = None, path: str | None = None) -> DataFrame:
    """Adds log_likelihood: the log of the sum over all paths (in the band)."""
    model = model or default_model()
    def kernel(frame: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        out = np.full(len(frame), np.nan)
        for places, x, y, band, _ in padded(_placed(frame, radius, path), radius):
            out[places] = model.likelihood(x, y, band)
        return np.arange(len(frame)), pd.DataFrame({"log_likelihood": pd.Series(out).where(pd.notna(out), None)})

    return map_rows(df, df.columns, _inputs(reference, query, path), "log_likelihood double", kernel)


def both_likelihoods(df: DataFrame, reference: str, query: str, model: K.PairModel | None = None, radius: int | None = None, path: str | None = None) -> DataFrame:
    """Adds forward and backward: the log-likelihood by either table; null for a null sequence, and where no path is reached.

    The two agree up to rounding; where they differ by more than AGREE (`agrees` says no, as it does for nulls), the read's
    numbers ran out of range and can't be trusted.
    """
    model = model or default_model()
    def kernel(frame: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        out = np.full((2, len(frame)), np.nan)
        for places, x, y, band, _ in padded(_placed(frame, radius, path), radius):
            out[:, places] = model.likelihoods(x, y, band)
        out[~np.isfinite(out)] = np.nan
        return np.arange(len(frame)), pd.DataFrame({c: pd.Series(v).where(pd.notna(v), None) for c, v in zip(("forward", "backward"), out, strict=True)})

    found = map_rows(df, df.columns, _inputs(reference, query, path), "forward double, backward double", kernel)
    return found.withColumn("agrees", F.coalesce(F.abs(F.col("forward") - F.col("backward")) <= K.AGREE, F.lit(False)))


def best_paths(df: DataFrame, reference: str, query: str, model: K.PairModel | None = None, radius: int | None = None, path: str | None = None) -> DataFrame:
    """Adds log_likelihood and ops of the most likely path; mismatches are told from matches."""
    model = model or default_model()
    def kernel(frame: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        out: list[tuple] = [(None, None)] * len(frame)
        for places, x, y, band, pads in padded(_placed(frame, radius, path), radius):
            tables = model.viterbi_table(x, y, band)
            before = np.array(pads)
            for p, found in zip(places.tolist(), model.viterbi_paths(tables, x, y, band.starts, before, before), strict=True):
                out[p] = found
        return np.arange(len(frame)), pd.DataFrame(out, columns=["log_likelihood", "ops"])

    return map_rows(df, df.columns, _inputs(reference, query, path), "log_likelihood double, ops string", kernel)
