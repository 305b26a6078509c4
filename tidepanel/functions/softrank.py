"""Sums of clamped logistics over all pairs of a date without the pairs.

Scores are sorted and cut into cells. The logistic is smooth over a cell, so that its sources may be moved to a few Chebyshev
points of the cell, and targets read off the points of theirs (errors near 1e-13). Cells beyond the clamp count as a whole. In the
two cells where the clamp sets in, what the clamped logistic differs by is a short series of exponentials, whose sums are
running sums in the order of the scores: the result is that of all pairs but for rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Points of a cell, its width in units of the temperature (a divisor of the clamp), and terms of the series beyond the clamp.
POINTS, WIDTH, TERMS = 14, 0.5, 5
NODES = np.cos((np.arange(POINTS) + 0.5) * np.pi / POINTS) / 2 + 0.5
ORDERS = np.arange(POINTS)


def _weights(at: np.ndarray) -> np.ndarray:
    """Rows that spread a place of [0, 1] over the points: polynomial interpolation by Chebyshev sums."""
    basis = np.cos(ORDERS * np.arccos(np.clip(2 * at - 1, -1, 1))[:, None])
    nodes = np.cos(ORDERS[:, None] * np.arccos(np.clip(2 * NODES - 1, -1, 1)))
    return (2 * basis @ nodes - 1) / POINTS


def _beyond(y: np.ndarray, cell: np.ndarray, of: dict[int, tuple[int, int]], ahead: int, clamp: float) -> np.ndarray:
    """For each y (sorted) the sum of sigma(clamp) - sigma(d) over the y_j of the cell `ahead` with d = y_j - y > clamp."""
    out = np.zeros(len(y))
    top = 1 / (1 + np.exp(-clamp))
    for c, (a, b) in of.items():
        lo, hi = of.get(c + ahead, (0, 0))
        if lo == hi:
            continue
        ys, base = y[lo:hi], (c + ahead) * WIDTH
        k = np.searchsorted(ys, y[a:b] + clamp, side="right")
        total = (hi - lo - k) * (top - 1)
        # sigma(d) = 1 - e^-d + e^-2d - ..., and e^-m(y_j - y) is a product of one factor a side
        for m in range(1, TERMS + 1):
            after = np.append(np.cumsum(np.exp(-m * (ys - base))[::-1])[::-1], 0.0)[k]
            total = total - (-1) ** m * np.exp(m * (y[a:b] - base)) * after
        out[a:b] = total
    return out


def sums_of_date(z: np.ndarray, tau: float, clamp: float) -> np.ndarray:
    """sum_j sigma(clip((z_j - z_i) / tau, -clamp, clamp)) for each i, itself included."""
    order = np.argsort(z, kind="stable")
    y = z[order] / tau
    cell = np.floor(y / WIDTH).astype(np.int64)
    cells, first, counts = np.unique(cell, return_index=True, return_counts=True)
    of = {int(c): (int(a), int(a + n)) for c, a, n in zip(cells, first, counts, strict=True)}
    w = _weights(y / WIDTH - cell)
    moved = np.add.reduceat(w, first, axis=0)
    reach = round(clamp / WIDTH)
    at_points = np.zeros_like(moved)
    place = {int(c): k for k, c in enumerate(cells)}
    for d in range(-reach, reach + 1):
        pairs = [(k, place[c + d]) for c, k in place.items() if c + d in place]
        if pairs:
            t, s = np.array(pairs).T
            kernel = 1 / (1 + np.exp(-(d + NODES[None, :] - NODES[:, None]) * WIDTH))
            at_points[t] += moved[s] @ kernel.T
    near = np.einsum("ij,ij->i", w, at_points[np.repeat(np.arange(len(cells)), counts)])
    upto = np.append(0, np.cumsum(counts))
    above = upto[-1] - upto[np.searchsorted(cells, cells + reach, side="right")]
    below = upto[np.searchsorted(cells, cells - reach, side="left")]
    far = above / (1 + np.exp(-clamp)) + below / (1 + np.exp(clamp))
    # below the clamp everything is mirrored: sigma(-d) = 1 - sigma(d)
    back = {-c - 1: (len(y) - b, len(y) - a) for c, (a, b) in of.items()}
    mirrored = _beyond(-y[::-1], cell, back, reach, clamp)[::-1]
    out = np.empty(len(y))
    out[order] = near + np.repeat(far, counts) + _beyond(y, cell, of, reach, clamp) - mirrored
    return out


def logistic_sums(df: DataFrame, tau: float, clamp: float) -> DataFrame:
    """(date, symbol, total) of (date, symbol, z): sum over the date's rows j, itself included, of the logistic of (z_j - z) / tau
    clamped. Rows without a finite z have no total and count for none."""
    types = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        z = table.column("z").to_numpy().astype(float)
        there = np.isfinite(z)
        total = np.full(len(z), np.nan)
        if there.any():
            total[there] = sums_of_date(z[there], tau, clamp)
        return pa.table({"date": table.column("date"), "symbol": table.column("symbol"), "total": pa.array(total, mask=~there)})

    return df.groupBy("date").applyInArrow(run, f"date {types['date']}, symbol {types['symbol']}, total double")
