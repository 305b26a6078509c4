"""Both ends of the spectrum against a dense solver, and the wide shape in tiles."""

import numpy as np
import pytest

from tidepanel.operators import ingest, risk, spectrum


def frame(spark, m, names=None):
    n = len(m)
    names = names or [f"s{k:03d}" for k in range(n)]
    rows = [(names[i], names[j], float(m[i, j])) for i in range(n) for j in range(i, n)]
    return spark.createDataFrame(rows, "sym_i string, sym_j string, cov double")


def test_ends_equal_a_dense_solver(spark):
    rng = np.random.default_rng(6)
    n = 60
    common = rng.normal(size=(n, 1))
    m = common @ common.T * 0.5 + np.diag(np.concatenate(([0.05], rng.uniform(0.3, 3, n - 1))))
    true = np.linalg.eigvalsh(m)
    cov = frame(spark, m)
    r = spectrum.cov_spectrum(cov).first()
    assert r.converged and r.n == n and r.steps < n
    assert abs(r.lowest - true[0]) <= 0.01 * true[0] and abs(r.highest - true[-1]) <= 0.01 * true[-1]
    assert r.lower <= true[0] * (1 + 1e-9) and r.upper >= true[-1] * (1 - 1e-9)
    assert r.surely_definite and not risk.cov_bounds(cov).first().surely_definite
    # a few steps settle nothing: row sums are the fallback
    short = spectrum.cov_spectrum(cov, steps=3).first()
    rows = risk.cov_bounds(cov).first()
    assert not short.converged and (short.lower, short.upper) == pytest.approx((rows.lower, rows.upper))


def test_singular_indefinite_and_small_matrices(spark):
    rng = np.random.default_rng(7)
    thin = rng.normal(size=(30, 4))
    r = spectrum.cov_spectrum(frame(spark, thin @ thin.T)).first()
    true = np.linalg.eigvalsh(thin @ thin.T)
    assert r.converged and r.steps <= 6 and abs(r.lowest) < 1e-8 and abs(r.highest - true[-1]) < 1e-6 * true[-1]
    r = spectrum.cov_spectrum(frame(spark, np.array([[1.0, 2.0], [2.0, 1.0]]))).first()
    assert (r.lowest, r.highest) == pytest.approx((-1, 3)) and not r.surely_definite
    r = spectrum.cov_spectrum(frame(spark, np.array([[4.0]]))).first()
    assert (r.lowest, r.highest, r.steps, r.condition_bound) == pytest.approx((4, 4, 1, 1))
    r = spectrum.cov_spectrum(frame(spark, np.zeros((3, 3)))).first()
    assert (r.lowest, r.highest, r.steps) == (0, 0, 1) and not r.surely_definite
    assert spectrum.cov_spectrum(frame(spark, np.zeros((3, 3))).where("cov > 0")).count() == 0
    odd = spark.createDataFrame([("a", "a", 2.0), ("b", "b", 3.0), ("a", "b", None), (None, "b", 1.0)], "sym_i string, sym_j string, cov double")
    r = spectrum.cov_spectrum(odd).first()
    assert (r.n, r.lowest, r.highest) == (2, pytest.approx(2), pytest.approx(3))


def test_shift_from_sharp_bounds(spark):
    """The conditioned matrix keeps both limits with a smaller shift than row sums give."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 40)) + rng.normal(size=(1, 40)) * 2
    m = np.cov(x)
    cov = frame(spark, m)
    sharp = risk.cov_condition(cov, bounds=spectrum.cov_spectrum(cov), most=50.0).collect()
    plain = risk.cov_condition(cov, most=50.0).first().eps
    assert sharp[0].eps < plain
    k = {s: i for i, s in enumerate(sorted({r.sym_i for r in sharp}))}
    out = np.zeros_like(m)
    for r in sharp:
        out[k[r.sym_i], k[r.sym_j]] = out[k[r.sym_j], k[r.sym_i]] = r.cov
    values = np.linalg.eigvalsh(out)
    assert values[0] >= 1e-6 and values[-1] / values[0] <= 50 * (1 + 1e-6)


def test_wide_rows_in_tiles(spark):
    rows = [(d, f"s{k}", float(d * 100 + k)) for d in range(4) for k in range(11) if (d + k) % 3] + [(9, None, 1.0), (2, "s3", None), (7, "s1", None)]
    x = spark.createDataFrame(rows, "day int, name string, price double")
    wide, names = ingest.long_to_tiles(x, "day", "name", "price", width=4)
    assert len(wide.columns) == 6 and names.count() == 11 and wide.select("tile").distinct().count() == 3
    got = sorted(map(tuple, ingest.tiles_to_long(wide, names, "day", "name", "price").collect()))
    assert got == sorted(r for r in rows if r[1] is not None and r[2] is not None)
    assert ingest.tiles_to_long(*ingest.long_to_tiles(x.where("day > 99"), "day", "name", "price"), "day", "name", "price").count() == 0
