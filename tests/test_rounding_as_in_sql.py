"""Columns are rounded as the SQL rounds them, halves and large numbers included, and not through decimal strings (F2)."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidepanel.plans.registry import _rounded


def test_rounded_equals_duckdb(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 40_000) * 10.0 ** rng.integers(-9, 19, 40_000)
    x = np.concatenate((x, np.arange(-40, 41) / 8, np.arange(-200, 201) / 2000, [0.0, -0.0, np.inf, -np.inf, np.nan, 1e305, -1e305, 5e-324, 0.49999999999999994e-4, 2.0**52 + 1, 4503599627370497.5e-4]))
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, x double")
    plan = df.select(_rounded(F.col("x"), 4))._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan
    for digits in (0, 2, 3, 4, 6, 8):
        got = np.array([r.y for r in df.select("k", _rounded(F.col("x"), digits).alias("y")).orderBy("k").collect()])
        want = duckdb.from_arrow(__import__("pyarrow").table({"k": np.arange(len(x)), "x": x})).project(f"k, round(x, {digits}) AS y").order("k").fetchnumpy()["y"]
        assert np.array_equal(got, want, equal_nan=True)
    assert spark.range(1).select(_rounded(F.lit(None).cast("double"), 3)).first()[0] is None
