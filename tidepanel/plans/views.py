"""Canonical input tables as views over the base tables; the SQL is common to Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "daily_bars": """SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
       CASE l_suppkey % 4 WHEN 0 THEN 'EQUITY' WHEN 1 THEN 'ETF' WHEN 2 THEN 'TEFAS_FREE' ELSE 'TEFAS_LIQUID' END AS asset_type,
       SUM(l_extendedprice) / SUM(l_quantity) AS close, MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low,
       SUM(l_quantity) AS volume, SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS auction_volume,
       CASE l_suppkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS settlement_days
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "monthly_panel": """SELECT symbol, asset_type, CAST(date_trunc('month', date) AS DATE) AS date, max_by(close, date) AS close,
       MAX(high) AS high, MIN(low) AS low, SUM(volume) AS volume
FROM daily_bars GROUP BY symbol, asset_type, CAST(date_trunc('month', date) AS DATE)""",
    "intraday_bars": """SELECT user_id AS symbol, date_trunc('hour', ts) AS ts,
       CASE user_id % 4 WHEN 0 THEN 'EQUITY' WHEN 1 THEN 'ETF' WHEN 2 THEN 'TEFAS_FREE' ELSE 'TEFAS_LIQUID' END AS asset_type,
       max_by(value, ts) AS price, MAX(value) AS high, MIN(value) AS low, CAST(SUM(1 + event_id % 97) AS DOUBLE) AS volume,
       CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 + event_id % 97 ELSE 0 END) AS DOUBLE) AS auction_volume
FROM events GROUP BY user_id, date_trunc('hour', ts)""",
    "fundamentals": """SELECT l.l_suppkey AS ticker, CAST(date_trunc('quarter', l.l_shipdate) AS DATE) AS as_of, MIN(n.n_regionkey) AS sector,
       SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue,
       SUM(l.l_extendedprice * (0.05 - l.l_discount + 0.25 * l.l_tax)) AS ebit, 0.02 * SUM(l.l_extendedprice) AS depreciation,
       SUM(CASE WHEN l.l_returnflag = 'R' THEN 0.005 * l.l_extendedprice ELSE 0 END) AS one_off_income,
       0.4 * SUM(l.l_extendedprice) AS total_liabilities, 0.7 * SUM(l.l_extendedprice) + 20 * MIN(s.s_acctbal) AS total_assets,
       20.0 * (1 + l.l_suppkey % 7) AS shares_outstanding
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY l.l_suppkey, CAST(date_trunc('quarter', l.l_shipdate) AS DATE)""",
    "book_levels": """SELECT user_id AS ticker, ts, CASE WHEN event_type IN ('click', 'purchase') THEN 'BID' ELSE 'ASK' END AS side,
       value AS price, CAST(1 + event_id % 97 AS DOUBLE) AS volume FROM events""",
    "broker_flow": """SELECT l_partkey % 50 AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS as_of, l_suppkey AS broker,
       SUM(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net_lot, SUM(l_quantity) AS gross_lot
FROM lineitem GROUP BY l_partkey % 50, CAST(date_trunc('quarter', l_shipdate) AS DATE), l_suppkey""",
    "custody": """SELECT o_custkey % 50 AS ticker, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderpriority AS custodian,
       SUM(o_totalprice) / 100 AS shares
FROM orders GROUP BY o_custkey % 50, CAST(date_trunc('week', o_orderdate) AS DATE), o_orderpriority""",
    "cards": """SELECT o_orderkey AS card_id, o_custkey % (SELECT COUNT(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS issue_date,
       o_totalprice / 50 AS price FROM orders""",
    "label_spans": """SELECT symbol, rn AS start_t, rn + 1 + CAST(volume AS INT) % 9 AS end_t, r AS ret
FROM (SELECT symbol, volume, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date) AS rn,
             close / LAG(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM daily_bars) t WHERE r IS NOT NULL""",
    # derived tables
    "panel_returns": """SELECT *, close / LAG(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM monthly_panel""",
    "predictions": """SELECT date, symbol, asset_type, score, actual FROM (SELECT date, symbol, asset_type,
       SUM(coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS score,
       LEAD(ret) OVER (PARTITION BY symbol ORDER BY date) AS actual FROM panel_returns) t WHERE actual IS NOT NULL""",
    "weights": """SELECT asset_type AS portfolio, date AS step, symbol, volume / SUM(volume) OVER (PARTITION BY asset_type, date) AS weight, ret
FROM panel_returns""",
    "signals": """SELECT symbol, date, close, 0.15 + 0.70 * percent_rank() OVER (PARTITION BY date ORDER BY vol_k, symbol) AS p_success,
       percent_rank() OVER (PARTITION BY date ORDER BY mom, symbol) AS p_bull, 1 - percent_rank() OVER (PARTITION BY date ORDER BY mom, symbol) AS p_bear,
       close * 0.02 AS atr
FROM (SELECT symbol, date, close, high / low AS vol_k, close / LAG(close, 4) OVER (PARTITION BY symbol ORDER BY date) - 1 AS mom FROM monthly_panel) t
WHERE mom IS NOT NULL""",
    "company": """SELECT f.ticker, f.as_of, f.sector, f.revenue, f.ebit, f.depreciation, f.one_off_income, f.total_assets, f.total_liabilities,
       f.shares_outstanding, p.px AS price, p.vol AS volume, f.shares_outstanding * p.px * 40 AS market_cap, 0.75 * f.ebit + f.one_off_income AS net_income,
       f.total_assets - f.total_liabilities AS equity, 0.5 * f.total_liabilities - 0.25 * f.total_assets AS net_debt, f.ebit + f.depreciation AS ebitda,
       0.03 * f.total_assets AS goodwill, 0.02 * f.total_assets AS intangibles, 0.01 * f.total_assets AS deferred_tax, 0.05 * f.one_off_income AS revaluation,
       0.06 * f.depreciation AS leases, 0.01 * f.revenue AS stock_pay, 0.004 * f.revenue AS capitalised_capex, 0.02 * f.revenue AS capex,
       0.9 * f.ebit + f.depreciation AS operating_cash, 0.35 * f.total_assets AS current_assets, 0.45 * f.total_liabilities AS current_liabilities,
       0.1 * f.total_assets AS inventories, 0.04 * f.total_assets AS related_receivables, 0.01 * f.total_assets AS doubtful_receivables,
       0.05 * f.total_assets AS cash, 0.1 * p.vol AS free_float_shares, 0.2 + 0.05 * (f.ticker % 5) AS risk_free, 12.0 + f.ticker % 9 AS growth_pct, 0.003 * f.revenue * (f.ticker % 2) AS one_off_expense, 0.5 * f.total_liabilities AS gross_debt,
       0.01 * f.total_assets * (f.ticker % 3) AS restricted_cash, 0.02 * f.total_assets AS associates, 0.015 * f.total_assets AS minority
FROM fundamentals f JOIN (SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS q, max_by(close, date) AS px, SUM(volume) AS vol
     FROM daily_bars GROUP BY symbol, CAST(date_trunc('quarter', date) AS DATE)) p ON p.symbol = f.ticker AND p.q = f.as_of""",
}

NEEDS = {"company": ["daily_bars", "fundamentals"], "monthly_panel": ["daily_bars"], "label_spans": ["daily_bars"], "panel_returns": ["monthly_panel"], "predictions": ["panel_returns"], "weights": ["panel_returns"], "signals": ["monthly_panel"]}

#: Column by which the base table of a view is dealt before its groups are made, and rows of a task.
CLUSTERED, TASK_ROWS = {"daily_bars": "l_suppkey", "intraday_bars": "user_id"}, 500_000

#: max_by as DuckDB has it: of rows that tie the first one of the table counts, and rows without a value do not (Spark's takes the last
#: one that it meets, null or not). By view: key, order and value of its base table, and what Spark is asked for instead.
TIES = {"intraday_bars": ("user_id", "ts", "value", "max_by(value, ts)", "max_by(at_tie, CASE WHEN at_tie IS NOT NULL THEN ts END)")}


def ordered(names: list[str]) -> list[str]:
    """The views and what they need, each after its inputs."""
    out: list[str] = []
    for n in names:
        for x in [*ordered(NEEDS.get(n, [])), n]:
            if x not in out:
                out.append(x)
    return out


def with_views(names: list[str], body: str) -> str:
    """DuckDB SQL: the views as common table expressions before the body."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered(names))
    body = body.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        recursive = rest[:10].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' if recursive else ''}{views},\n{rest[10:] if recursive else rest}"
    return f"WITH {views}\n{body}"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame) -> int:
    return max(-(-df.count() // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, column: str) -> DataFrame:
    """df with the rows of a value together, about TASK_ROWS in a task: groups and windows by the column need no other shuffle, and
    a task's tables grow neither with the files nor with what fits into a shuffle block of well compressed rows."""
    return df.repartition(tasks(df), column)


def settled(df: DataFrame, column: str, key: str, order: str, value: str) -> DataFrame:
    """df, a table as it is read, dealt by column, with at_tie: of the rows of a key at one place of the order the first value, in the
    order of the table's files and rows. Rows that tie then say the same, in whatever order they meet."""
    tie = Window.partitionBy(key, order).orderBy("_file", "_row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = dealt(df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")), column)
    return x.withColumn("at_tie", F.first(value, ignorenulls=True).over(tie)).drop("_file", "_row")


def dealt_as_bars(df: DataFrame, sf_dir: str, column: str) -> DataFrame:
    """df with the rows of a symbol in the task that has its daily bars (same number of tasks, same type of key)."""
    return df.repartition(tasks(base(df.sparkSession, sf_dir, "lineitem")), column)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table; Spark SQL over the base tables, which are named as DataFrame arguments."""
    sql, frames = VIEWS[name], {}
    import re

    for t in [*BASE, *VIEWS]:
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            frames[t] = base(spark, sf_dir, t) if t in BASE else view(spark, sf_dir, t)
            if name in TIES and t in BASE:
                *by, said, asked = TIES[name]
                frames[t], sql = settled(frames[t], CLUSTERED[name], *by), sql.replace(said, asked)
            elif name in CLUSTERED and t in BASE:
                frames[t] = dealt(frames[t], CLUSTERED[name])
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)
