"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL = "symbol long, date date, asset_type string, close double, high double, low double, volume double, auction_volume double, settlement_days int"
METRICS = "timestamp timestamp, event string, metrics map<string,double>, metadata map<string,string>"


def read_panel(spark: SparkSession, path: str, schema: str = PANEL) -> DataFrame:
    """Daily panel with a declared schema; filters on date and symbol reach the files."""
    return spark.read.schema(schema).parquet(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet partitioned by year, rows of a year together."""
    df.withColumn("year", F.year("date")).repartition("year", F.pmod(F.hash("symbol"), F.lit(16))).write.mode("overwrite").partitionBy("year").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int = 256, path: str | None = None) -> None:
    """Table of the session's catalog, dealt into buckets by symbol and sorted by symbol and date.

    Windows over the history of a symbol, and joins of such tables by symbol, need no shuffle and no sort: all files of a
    bucket are one partition, and there is one file a bucket. Files go to path, else to the warehouse; all executors must
    reach them.
    """
    out = df.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "date")
    (out.option("path", path) if path else out).saveAsTable(table)


def append_metrics(df: DataFrame, path: str) -> None:
    df.select("timestamp", "event", "metrics", "metadata").write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def append_signals(df: DataFrame, path: str) -> None:
    """Append-only history; each write adds its own files."""
    df.write.mode("append").parquet(path)
