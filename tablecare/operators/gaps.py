"""Gaps against numbers: which cells are missing together, and with what numbers beside them.

One pass over a table gives, for each pair of a column with gaps and a number column, how many gaps have a number beside
them and what these numbers sum up to, and for each pair of columns with gaps how many rows have both. From that follow
the correlations of every gap marker with every number column, as the table is and as it will be when gaps of a column
are filled with a value; only a table that loses rows has to be read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isclose, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions.cells import missing, number

#: Tasks of the pass for each core: each sends one partial matrix.
TASKS_A_CORE = 4
#: Numbers that differ by less than this share of their mean are a constant, added up in another order.
SAME = 1e-14


@dataclass
class Gaps:
    """What is known of a table's gaps; `beside` and `near` are sums (numbers less their mean) and counts by (gap, number), `both` counts by (gap, gap)."""

    rows: int
    gaps: list[str]
    numbers: list[str]
    missing: dict[str, int]
    count: np.ndarray
    mean: np.ndarray
    spread: np.ndarray  # sums of squares about the mean
    beside: np.ndarray
    near: np.ndarray
    both: np.ndarray
    unfilled: np.ndarray  # means before anything was filled

    def correlation(self, column: str) -> float | None:
        """Mean |correlation| of a column's gap marker with every other number column of ten values or more; null where there is none."""
        if self.rows < R.MCAR_ROWS or not self.missing[column]:
            return None
        g, found = self.gaps.index(column), []
        for i, name in enumerate(self.numbers):
            n, marked = int(self.count[i]), int(self.near[g, i])
            if name != column and n >= R.MCAR_ROWS and self.spread[i] > 0 and 0 < marked < n:
                share = marked / n
                found.append(abs(self.beside[g, i] / n / sqrt(share * (1 - share)) / sqrt(self.spread[i] / n)))
        return float(sum(found) / len(found)) if found else None

    def random(self, column: str) -> bool:
        mean = self.correlation(column)
        return mean is None or mean < R.MCAR_BELOW

    def fill(self, column: str, value: float | None) -> None:
        """The table's gaps of a column take a value: what follows for it as a number column beside other gaps."""
        g, gone = self.gaps.index(column), self.missing[column]
        self.missing[column] = 0
        if value is None or column not in self.numbers or not gone:
            return
        i = self.numbers.index(column)
        n, off = self.count[i], value - self.mean[i]
        if self.spread[i] == 0 and n and isclose(value, self.mean[i], rel_tol=1e-12):
            off = 0.0  # a constant stays one
        more = self.both[:, g]
        shift = off * gone / (n + gone)
        self.near[:, i] += more
        self.beside[:, i] += more * off - self.near[:, i] * shift
        self.spread[i] += off * off * n * gone / (n + gone)
        self.mean[i] += shift
        self.count[i] = n + gone


def held(df: DataFrame, gaps: list[str], numbers: list[str], means: np.ndarray | None = None) -> Gaps:
    """One pass over a table, however many columns it has, and one before it for the means, where none are given that are near."""
    values, flags = [number(df, c) for c in numbers], [missing(df, c) for c in gaps]
    named = df.select(*[v.alias(f"n{i}") for i, v in enumerate(values)], *[f.alias(f"g{i}") for i, f in enumerate(flags)])
    m, k = len(numbers), len(gaps)
    if means is None:
        first = named.agg(F.count("*"), *[F.avg(f"n{i}") for i in range(m)]).first()
        means = np.array([x or 0.0 for x in first[1:]])
    # The last row and column are of all rows; numbers are less the means given, so that sums of squares lose nothing.
    n, total, squares = np.zeros((k + 1, m + k + 1), np.int64), np.zeros((k + 1, m)), np.zeros(m)
    for r in _sums(named, means.tolist(), k).collect():  # a row a pair of columns
        n[r.gap, r.other] = r.n
        if r.other < m:
            total[r.gap, r.other] = r.total
            if r.gap == k:
                squares[r.other] = r.squares
    count, own = n[k, :m], total[k] / np.maximum(n[k, :m], 1)
    mean = means + own
    spread = squares - own * own * count
    spread[spread <= count * (SAME * mean) ** 2] = 0
    return Gaps(int(n[k, m + k]), list(gaps), list(numbers), {c: int(n[g, m + k]) for g, c in enumerate(gaps)}, count, mean, spread, total[:k] - n[:k, :m] * own, n[:k, :m], n[:k, m : m + k], mean.copy())


def _sums(named: DataFrame, means: list[float], gaps: int) -> DataFrame:
    """gap, other, n, total, squares: matrix products a batch, a partial matrix a task, summed by pair.

    other is a number column, or after these a gap; the last of either is all rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(means)
        n, total, squares = np.zeros((gaps + 1, m + gaps + 1)), np.zeros((gaps + 1, m)), np.zeros(m)
        for batch in batches:
            rows = batch.num_rows
            x = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(m)], np.float64).reshape(m, rows).T - np.array(means)
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            flags = np.ones((gaps + 1, rows))
            for g in range(gaps):
                flags[g] = batch.column(m + g).to_numpy(zero_copy_only=False)
            n += flags @ np.concatenate([there, flags.T], 1)
            total += flags @ x
            squares += (x * x).sum(0)
        if n[-1, -1]:
            gap, other = np.nonzero(n)
            wide = lambda a: np.concatenate([a, np.zeros((len(a), gaps + 1))], 1)
            own = np.zeros((gaps + 1, m))
            own[-1] = squares
            yield pa.RecordBatch.from_pydict({"gap": gap.astype(np.int32), "other": other.astype(np.int32), "n": n[gap, other].astype(np.int64), "total": wide(total)[gap, other], "squares": wide(own)[gap, other]})

    tasks = TASKS_A_CORE * named.sparkSession.sparkContext.defaultParallelism
    return named.coalesce(tasks).mapInArrow(work, "gap int, other int, n long, total double, squares double").groupBy("gap", "other").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
