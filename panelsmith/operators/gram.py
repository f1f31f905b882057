"""Means, deviations and covariances of every two columns, for up to thousands of columns, in one scan.

Aggregating pair by pair reads the table once for every hundred pairs.  Here a
task turns its rows into a matrix and keeps, for every two columns, what it
knows of the rows in which both are present: how many there are, the mean and
the sum of squared deviations of either, and the sum of products of deviations.
A few matrix products update all pairs at once.  What tasks have found is cut
into square blocks of columns and merged block by block.

Sums are of deviations from a mean close by, and two parts are merged by the
difference of their means, so that large means do not swallow small deviations.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions travel to the workers as code, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIDE = 64  # columns of a block
STATE_CELLS = 1 << 23  # pairs that a task keeps; with more columns the table is read several times
FLAT = 1e-12  # a deviation below this share of the mean counts as none


class Moments:
    """For every two columns a (first) and b: rows with both, mean and squares of a, products of a and b."""

    def __init__(self, n: np.ndarray, mean_a: np.ndarray, mean_b: np.ndarray, square_a: np.ndarray, square_b: np.ndarray, product: np.ndarray):
        self.parts = (n, mean_a, mean_b, square_a, square_b, product)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Moments:
        """Of two sets of columns over the same rows; NaN stands for missing."""
        (a, here_a, shift_a), (b, here_b, shift_b) = _shifted(a), _shifted(b)
        n = here_a.T @ here_b
        some = np.maximum(n, 1)
        sum_a, sum_b = a.T @ here_b, here_a.T @ b
        mean_a, mean_b = sum_a / some, sum_b / some
        return cls(n, shift_a[:, None] + mean_a, shift_b[None, :] + mean_b, (a * a).T @ here_b - sum_a * mean_a,
                   here_a.T @ (b * b) - sum_b * mean_b, a.T @ b - sum_a * mean_b)

    def merged(self, other: Moments) -> Moments:
        n1, a1, b1, aa1, bb1, ab1 = self.parts
        n2, a2, b2, aa2, bb2, ab2 = other.parts
        n = n1 + n2
        share = n2 / np.maximum(n, 1)
        weight = n1 * share
        da, db = np.where((n1 > 0) & (n2 > 0), a2 - a1, 0), np.where((n1 > 0) & (n2 > 0), b2 - b1, 0)
        mean = lambda x, y, d: np.where(n1 == 0, y, x + d * share)
        return Moments(n, mean(a1, a2, da), mean(b1, b2, db), aa1 + aa2 + da * da * weight, bb1 + bb2 + db * db * weight, ab1 + ab2 + da * db * weight)

    def cut(self, rows: slice, columns: slice) -> Moments:
        return Moments(*(p[rows, columns] for p in self.parts))

    def packed(self) -> bytes:
        return np.stack(self.parts).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes, rows: int, columns: int) -> Moments:
        return cls(*np.frombuffer(data, "<f8").reshape(6, rows, columns))


def _shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values less the mean of their column, missing ones 0; 1 where there is a value; the means."""
    here = ~np.isnan(x)
    if not len(x):
        return x, here.astype(float), np.zeros(x.shape[1])
    n = here.sum(axis=0)
    first = np.where(n > 0, x[here.argmax(axis=0), np.arange(x.shape[1])], 0.0)  # equal values leave nothing at all
    y = np.where(here, x - first, 0.0)
    mean = y.sum(axis=0) / np.maximum(n, 1)
    return np.where(here, y - mean, 0.0), here.astype(float), first + mean


def _blocks(count: int) -> list[tuple[int, slice]]:
    return [(i, slice(lo, min(lo + SIDE, count))) for i, lo in enumerate(range(0, count, SIDE))]


def _task_moments(band: slice, count: int):
    """Moments of the columns of ``band`` with all others, as blocks on and above the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            now = Moments.of(x[:, band], x)
            state = now if state is None else state.merged(now)
        if state is None:
            return
        for i, rows in _blocks(count):
            if not band.start <= rows.start < band.stop:
                continue
            for j, columns in _blocks(count)[i:]:
                part = state.cut(slice(rows.start - band.start, rows.stop - band.start), columns)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part.packed()], pa.binary())], names=["i", "j", "part"])

    return run


def _merged_blocks(count: int):
    """Merge the parts of each block, which come one after another, and give a row for each pair."""
    spans = dict(_blocks(count))

    def rows(i: int, j: int, state: Moments) -> pa.RecordBatch:
        a, b = (np.arange(s.start, s.stop) for s in (spans[i], spans[j]))
        n, _, _, square_a, square_b, product = state.parts
        one, other = np.nonzero(a[:, None] < b[None, :])
        mean_a, mean_b = state.parts[1], state.parts[2]
        spread = (square_a > n * (FLAT * mean_a) ** 2) & (square_b > n * (FLAT * mean_b) ** 2)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(spread, product / np.sqrt(square_a * square_b), np.nan)
        columns = [p[one, other] for p in (n, mean_a, mean_b, square_a, square_b, product, value)]
        value = pa.array(columns[-1], mask=np.isnan(columns[-1]) & ~spread[one, other])
        return pa.RecordBatch.from_arrays(
            [pa.array(a[one], pa.int32()), pa.array(b[other], pa.int32()), pa.array(columns[0].astype(np.int64)), *map(pa.array, columns[1:-1]), value],
            names=["a", "b", "n", "mean_a", "mean_b", "square_a", "square_b", "product", "correlation"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for i, j, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                now = Moments.unpacked(part.as_py(), spans[i].stop - spans[i].start, spans[j].stop - spans[j].start)
                if key == (i, j):
                    state = state.merged(now)
                    continue
                if key is not None:
                    yield rows(*key, state)
                key, state = (i, j), now
        if key is not None:
            yield rows(*key, state)

    return run


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for every two of ``columns``, given by their places ``a`` < ``b``.

    ``n`` rows hold both; of these are the means, the sums of squared deviations
    and of products of deviations, and the ``correlation``, NULL where either is
    constant.  NULL and NaN count as missing.  Pairs without a row that holds
    both have n = 0; a table without rows gives no pairs.
    """
    count = len(columns)
    band = max(SIDE, STATE_CELLS // max(count, 1) // SIDE * SIDE)
    values = df.select(*[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(columns)])
    parts = [values.mapInArrow(_task_moments(slice(lo, min(lo + band, count)), count), "i int, j int, part binary") for lo in range(0, count, band)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    placed = found.repartition("i", "j").sortWithinPartitions("i", "j")
    return placed.mapInArrow(
        _merged_blocks(count),
        "a int, b int, n long, mean_a double, mean_b double, square_a double, square_b double, product double, correlation double")
