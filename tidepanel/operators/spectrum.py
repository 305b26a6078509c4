"""Both ends of a covariance's spectrum (R17, R18) by Lanczos steps whose products and sums are Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.cuts import cut
from tidepanel.operators.risk import cov_bounds, mirrored

STEPS, PRECISION = 60, 1e-3
#: Errors below this share of the largest eigenvalue count as none, so that singular matrices settle.
ROUNDING = 1e-10


def _sums(x: DataFrame, *columns: Column) -> np.ndarray:
    return np.array([v or 0.0 for v in x.agg(*[F.sum(c).alias(f"c{k}") for k, c in enumerate(columns)]).first()])


def _less(w: Column, parts: np.ndarray) -> Column:
    """w without its parts along the vectors of a row."""
    each = F.zip_with("vectors", F.lit([float(c) for c in parts]), lambda v, c: v * c)
    return w - F.aggregate(each, F.lit(0.0), lambda total, one: total + one)


def cov_spectrum(cov: DataFrame, steps: int = STEPS, precision: float = PRECISION) -> DataFrame:
    """R17 with sharp ends: one row (n, steps, lowest, highest, lowest_error, highest_error, converged, lower, upper,
    condition_bound, surely_definite) of the symmetric matrix cov (sym_i, sym_j, cov), i <= j.

    lowest and highest are the extreme Ritz values after `steps` Lanczos steps or fewer, each within its error of an
    eigenvalue. lower and upper are lowest - error and highest + error once both errors are below `precision` of their
    values, and the bounds from row sums otherwise or where these are sharper. They hold unless the start, drawn by hash,
    has no part along an extreme eigenvector. Rows with nulls are left out, pairs that are absent are zeros; without any
    row the result is empty.

    Each step is one product with the matrix (a join and an aggregation, combined before the shuffle) and two aggregations
    over one row per symbol; vectors stay on the executors, of which the driver sees a few sums a step.
    """
    spark = cov.sparkSession
    cov = cov.where("sym_i is not null and sym_j is not null and cov is not null").select("sym_i", "sym_j", "cov")
    pairs = cut(mirrored(cov))
    start = (F.pmod(F.xxhash64(F.lit(3), "symbol"), F.lit(1_000_003)) - 500_001) / 500_001.0
    state = pairs.groupBy(F.col("sym_i").alias("symbol")).agg(F.lit(0).alias("_")).select("symbol", F.array(start).alias("vectors"))
    n, norm = _sums(state, F.lit(1.0), F.col("vectors")[0] * F.col("vectors")[0])
    schema = "n long, steps int, lowest double, highest double, lowest_error double, highest_error double, converged boolean, lower double, upper double, condition_bound double, surely_definite boolean"
    if not n:
        return spark.createDataFrame([], schema)
    rows = cov_bounds(pairs.where("sym_i <= sym_j")).first()
    state = state.select("symbol", F.array(F.col("vectors")[0] / float(np.sqrt(norm))).alias("vectors"))
    alphas, betas = [], []
    for m in range(1, steps + 1):
        x = state.select(F.col("symbol").alias("sym_j"), F.col("vectors")[m - 1].alias("x"))
        product = pairs.join(x, "sym_j").groupBy("sym_i").agg(F.sum(F.col("cov") * F.col("x")).alias("w"))
        state = cut(state.join(product, F.col("symbol") == F.col("sym_i")).select("symbol", "vectors", "w"))
        along = [F.col("vectors")[k] for k in range(m)]
        # what rounding leaves along the earlier vectors is taken off a second time
        first = _sums(state, *[F.col("w") * v for v in along])
        rest = state.select("vectors", _less(F.col("w"), first).alias("w"))
        *second, square = _sums(rest, *[F.col("w") * v for v in along], F.col("w") * F.col("w"))
        second = np.array(second)
        beta = float(np.sqrt(max(0.0, square - (second**2).sum())))
        alphas.append(float(first[-1] + second[-1]))
        values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1))
        scale = float(np.abs(values).max())
        done = m >= n or beta <= 1e-14 * scale
        errors = np.zeros(2) if done else beta * np.abs(vectors[-1, [0, -1]])
        ends = values[[0, -1]]
        converged = bool((errors <= np.maximum(precision * np.abs(ends), ROUNDING * scale)).all())
        if done or converged:
            break
        betas.append(beta)
        state = state.select("symbol", F.concat("vectors", F.array((_less(F.col("w"), first + second)) / beta)).alias("vectors"))
    lower, upper = float(rows.lower), float(rows.upper)
    if converged:
        lower, upper = max(lower, float(ends[0] - errors[0])), min(upper, float(ends[1] + errors[1]))
    bound = upper / lower if lower > 0 else None
    return spark.createDataFrame([(int(n), m, float(ends[0]), float(ends[1]), float(errors[0]), float(errors[1]), converged, lower, upper, bound, lower > 0)], schema)
