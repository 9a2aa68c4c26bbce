"""Rank trends of series of any length: signs of all pairs by counting, the median slope by selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators.ordered import ordered_groups

#: Series with at most this many pairs have their slopes laid out; longer ones select the median.
PAIRS = 1 << 16
#: Values of a run that are compared by offset before runs are merged.
RUN = 32


def ordered_pairs(y: np.ndarray) -> tuple[int, int]:
    """How many pairs i < j rise (y[i] < y[j]) and fall, in n log n steps and memory of order n."""
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    n, run = len(rank), RUN
    place, up, down = np.arange(n) // run, 0, 0
    for gap in range(1, min(run, n)):
        d = (rank[gap:] - rank[:-gap])[place[gap:] == place[:-gap]]
        up, down = up + int((d > 0).sum()), down + int((d < 0).sum())
    merged = rank[np.lexsort((rank, place))]
    while run < n:
        for a in range(0, n - run, 2 * run):
            left, right = merged[a : a + run], merged[a + run : a + 2 * run]
            up += int(np.searchsorted(left, right, "left").sum())
            down += len(left) * len(right) - int(np.searchsorted(left, right, "right").sum())
            merged[a : a + 2 * run] = np.sort(merged[a : a + 2 * run], kind="stable")
        run *= 2
    return up, down


def _kth_slope(y: np.ndarray, k: int) -> float:
    """The k-th smallest slope (from 0) of all pairs, to twelve digits: pairs of at most a slope are those that don't rise after it is taken off."""
    x = np.arange(len(y), dtype=float)
    high = float(np.abs(np.diff(y)).max())
    low, high, digits = -high - 1e-9, high + 1e-9, 1e-13 * (1 + high)
    pairs = len(y) * (len(y) - 1) // 2
    while high - low > digits:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if pairs - ordered_pairs(y - mid * x)[0] > k:
            high = mid
        else:
            low = mid
    return high


def median_slope(y: np.ndarray) -> float:
    """Median of the slopes of all pairs of a series; 0 below two values."""
    n = len(y)
    pairs = n * (n - 1) // 2
    if pairs == 0:
        return 0.0
    if pairs <= PAIRS:
        i, j = np.triu_indices(n, 1)
        return float(np.median((y[j] - y[i]) / (j - i)))
    upper = _kth_slope(y, pairs // 2)
    return upper if pairs % 2 else (upper + _kth_slope(y, pairs // 2 - 1)) / 2


def mann_kendall(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """S, tau-b, two-sided probability and median slope of each group's series.

    Rows without order or value are left out; equal orders go by value; a series of
    one value has S, tau and slope 0 and probability 1. A task holds a batch of rows and one series, and as much again a few times.
    """

    def run(key, columns: dict[str, np.ndarray]) -> list[tuple]:
        y = columns[value].astype(float)
        n = len(y)
        up, down = ordered_pairs(y)
        s = up - down
        ties = np.unique(y, return_counts=True)[1].astype(float)
        var = (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18
        z = 0.0 if s == 0 or var <= 0 else (s - np.sign(s)) / np.sqrt(var)
        pairs, tied = n * (n - 1) / 2, float((ties * (ties - 1) / 2).sum())
        tau = s / np.sqrt(pairs * (pairs - tied)) if pairs > tied else 0.0
        return [(key, n, float(s), round(float(tau), 6), round(2 * S.normal_tail(abs(float(z))), 6), round(median_slope(y), 6))]

    kind = dict(rows.dtypes)[group]
    known = rows.select(group, order, value).where(F.col(order).isNotNull() & F.col(value).isNotNull())
    return ordered_groups(known, group, [order, value], run, f"{group} {kind}, n long, s double, tau double, p double, sen double")
