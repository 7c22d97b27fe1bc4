"""Sums of products of all pairs of columns, for wide tables, in one job.

Each task multiplies its batches as matrices and gives one row for each row of its partial
result. These are added up by row number as they stream by, so a task holds a few rows of
the matrix, however many partial results there are. Only the matrix, whose size is that of
the columns squared, comes to the driver. A plan of d columns holds d expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL = pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))])


@dataclass
class PairSums:
    """For each pair (i, j), over the rows that have both: weight, the sums of i and of its squares, and of the products i j.

    Values are less ``shift``.
    """

    weight: np.ndarray
    first: np.ndarray
    square: np.ndarray
    product: np.ndarray
    shift: np.ndarray

    def correlation(self) -> np.ndarray:
        """Pearson's correlations; NaN where one of a pair doesn't vary."""
        n = np.maximum(self.weight, 1e-300)
        mean = self.first / n
        var = np.maximum(self.square / n - mean**2, 0)
        var[var <= 1e-20 * np.maximum(1, self.shift[:, None] ** 2)] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.product / n - mean * mean.T) / np.sqrt(var * var.T)
        return np.where(var * var.T > 0, out, np.nan)

    def variance(self) -> np.ndarray:
        """Each column's own."""
        n = np.maximum(self.weight.diagonal(), 1e-300)
        return np.maximum(self.square.diagonal() / n - (self.first.diagonal() / n) ** 2, 0)


def rows_out(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(matrix), 64):
        part = matrix[at : at + 64]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype=np.int32)), flat], schema=PARTIAL)


def partial(d: int, weighted: bool, shift: np.ndarray, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums; ``whole`` leaves out all but the products."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, d if whole else 4 * d))
        for batch in batches:
            x = np.empty((batch.num_rows, d))
            for i in range(d):
                x[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
            there = np.isfinite(x)
            x = np.where(there, x - shift, 0.0)
            w = np.nan_to_num(batch.column(d).to_numpy(zero_copy_only=False))[:, None] if weighted else 1.0
            xw = x * w
            if whole:
                out += xw.T @ x
            else:
                m = there.astype(float)
                out += np.concatenate([(m * w).T @ m, xw.T @ m, (xw * x).T @ m, xw.T @ x], axis=1)
        yield from rows_out(out)

    return sums


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for i, row in zip(batch.column(0).to_pylist(), v):
                held[i] = held[i] + row if i in held else row.copy()
    for i, row in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], schema=PARTIAL)


def summed(df: DataFrame, columns: list[Column], weight: Column | None, shift: np.ndarray, whole: bool) -> np.ndarray:
    d = len(columns)
    rows = df.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)), *([] if weight is None else [weight.cast("double").alias("w")]))
    parts = rows.mapInArrow(partial(d, weight is not None, shift, whole), "i int, v array<double>")
    got = parts.repartition(F.col("i")).mapInArrow(added, "i int, v array<double>").toArrow()
    out = np.zeros((d, d if whole else 4 * d))
    if got.num_rows:
        out[got["i"].to_numpy()] = np.array(got["v"].combine_chunks().flatten()).reshape(got.num_rows, -1)
    return out


def pair_sums(df: DataFrame, columns: list[Column], weight: Column | None = None) -> PairSums:
    """Sums for every pair of columns over the rows that have both; missing, NaN and infinite values count as absent.

    One pass finds the means, which values are taken less so that sums keep their digits.
    """
    d = len(columns)
    finite = [F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double")) for c in columns]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(finite)]).first() if columns else []
    shift = np.array([m or 0.0 for m in means])
    out = summed(df, columns, weight, shift, False)
    return PairSums(*(out[:, k * d : (k + 1) * d] for k in range(4)), shift)


def products(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """X'WX of the columns as they are; missing values are left out of the sums."""
    return summed(df, columns, weight, np.zeros(len(columns)), True)
