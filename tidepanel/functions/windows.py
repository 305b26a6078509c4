"""Shared window specifications and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(key="symbol", order="date") -> WindowSpec:
    """The history of a key; the order column must be unique within it."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def last_rows(n: int, key="symbol", order="date") -> WindowSpec:
    """The row and the n - 1 before it."""
    return series(key, order).rowsBetween(-(n - 1), 0)


def running(key="symbol", order="date") -> WindowSpec:
    return series(key, order).rowsBetween(Window.unboundedPreceding, 0)


def cross_section(date="date", *more: str) -> WindowSpec:
    return Window.partitionBy(date, *more)


def rolled(fn, col: str | Column, n: int, at_least: int = 1, key="symbol", order="date") -> Column:
    """fn of the last n rows, null unless that many of them are not null."""
    c = F.col(col) if isinstance(col, str) else col
    w = last_rows(n, key, order)
    return F.when(F.count(c).over(w) >= at_least, fn(c).over(w))


def longer(sums: str, n: int, times: int, key="symbol", order="date") -> Column:
    """Sum of the last n * times rows from a column of sums of the last n, null where one of these is."""
    return sum((F.lag(sums, n * k).over(series(key, order)) for k in range(1, times)), F.col(sums))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded values; null stays null (least and greatest would skip it)."""
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(float(low))).otherwise(c)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def finite(c: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite or NaN where b is zero (the operator fails there in ANSI mode)."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b != 0, a / b).when((b == 0) & a.isNotNull(), zero)


def ln(c: Column) -> Column:
    """Natural logarithm as floating point has it: -infinite at zero, NaN below (the built-in one is null there)."""
    return F.when(c > 0, F.log(c)).when(c == 0, float("-inf")).when(c < 0, float("nan"))


def correlation(x: str, y: str) -> Column:
    """Aggregate Pearson correlation, null where one side does not vary (the built-in one fails there in ANSI mode)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.when((F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.covar_pop(x, y) / (F.stddev_pop(a) * F.stddev_pop(b)))


def cascade(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """Value of the first case that holds."""
    out = None
    for when, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, v) if out is None else out.when(when, v)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def average_rank(order: str, *keys: str) -> Column:
    """1-based rank within the keys, ties sharing their mean."""
    tied = F.count("*").over(Window.partitionBy(*keys, order))
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (tied - 1) / 2.0


def dates_indexed(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, idx) of the distinct dates, 0-based; the window runs over that small table only."""
    return df.select(date).distinct().withColumn("idx", F.row_number().over(Window.orderBy(date)) - 1)


def as_of(facts: DataFrame, probes: DataFrame, key: str, fact_ts: str, probe_ts: str, values: list[str]) -> DataFrame:
    """Each probe with the values of the latest fact at or before it: union and a running last, one shuffle, no range join."""
    left = facts.select(key, F.col(fact_ts).alias("_t"), F.lit(0).alias("_probe"), F.struct(F.col(fact_ts), *values).alias("_fact"), *[F.lit(None).cast(t).alias(c) for c, t in probes.dtypes if c not in (key,)])
    right = probes.select(key, F.col(probe_ts).alias("_t"), F.lit(1).alias("_probe"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), *[c for c in probes.columns if c != key])
    w = Window.partitionBy(key).orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_seen", F.last("_fact", ignorenulls=True).over(w))
    return both.where("_probe = 1").select(*probes.columns, F.col(f"_seen.{fact_ts}").alias(f"fact_{fact_ts}"), *[F.col(f"_seen.{v}").alias(v) for v in values])
