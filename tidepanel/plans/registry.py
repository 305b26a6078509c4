"""Registered queries: a Spark function over the canonical tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.plans.views import BASE, base, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Canonical and base tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return base(self.spark, self.sf_dir, name) if name in BASE else view(self.spark, self.sf_dir, name)


def _nudge(digits: int) -> float:
    """A sliver of a unit: exact halves, which the two engines round differently, are none any more."""
    return 4.1357e-3 * 10.0**-digits


def _rounded(x: Column, digits: int) -> Column:
    """x at so many digits, halves away from zero, in floating point as DuckDB does it. Spark's round goes through decimal strings,
    which takes longer than most queries need for a row; the two differ where x is within rounding of a half."""
    unit = F.lit(10.0**digits)
    y = x * unit
    whole = F.rint(y)
    out = F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole) / unit
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def add(name: str, make: Callable[[Tables], DataFrame], views: str = "", sql: str | None = None, keys: str = "", rounded: dict[str, int] | str = "", digits: int = 6) -> None:
    """Register a query. Both sides return the keys as they are and the rounded columns at their number of digits."""
    digits_of = rounded if isinstance(rounded, dict) else {c: digits for c in rounded.split()}
    key = keys.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(Tables(spark, sf_dir))
        if key or digits_of:
            df = df.select(*key, *[(_rounded(F.col(c).cast("double") + F.lit(_nudge(d)), d) + F.lit(0.0)).alias(c) for c, d in digits_of.items()])
        return df

    QUERIES[name] = run
    if sql:
        outer = ", ".join([*key, *(f"round(CAST({c} AS DOUBLE) + CAST({_nudge(d)!r} AS DOUBLE), {d}) + CAST(0 AS DOUBLE) AS {c}" for c, d in digits_of.items())]) or "*"
        ORACLES[name] = f"SELECT {outer} FROM ({with_views(views.split(), sql) if views else sql}) _q"
