"""Labels and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.windows import cascade, cross_section, dates_indexed, series


def forward_return(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("fwd", F.lead("close", n).over(series()) / F.col("close") - 1).where("fwd is not null")


def barrier_label(df: DataFrame, column: str = "fwd", up: float = 0.075, down: float = -0.04) -> DataFrame:
    return df.withColumn("label", cascade((F.col(column) >= up, 1), (F.col(column) <= down, -1), otherwise=0))


def path_barrier_outcome(cards: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome of cards (card_id, symbol, issue_date, due_date, target, stop): the target counts before the stop.

    A card open for 2^k to 2^(k+1) - 1 days meets two or three aligned blocks of 2^k days: it takes the extremes from its first
    day to the end of the one, those from the start of the other to its last day, and those of all of a block between. These are
    running extremes of the bars of a block, forwards and backwards, in which cards are rows as well. Bars are repeated for the
    lengths k of their symbol's cards. All of it stays where the symbol is: tables that are dealt by symbol into the same number
    of tasks are not shuffled again.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    opened = cards.withColumns({"_from": day("issue_date"), "_to": day("due_date")})
    opened = opened.withColumn("_level", F.when(F.col("_to") >= F.col("_from"), F.length(F.bin(F.col("_to") - F.col("_from") + 1)) - 1))
    paths = bars.where("symbol is not null and date is not null").select("symbol", day("date").alias("_from"), "high", "low", F.lit(False).alias("_card"))
    both = paths.unionByName(opened.select("card_id", "symbol", "target", "stop", "_from", "_to", "_level", F.lit(True).alias("_card")), allowMissingColumns=True)
    x = both.withColumn("_levels", F.collect_set("_level").over(Window.partitionBy("symbol")))
    x = x.withColumn("_level", F.explode_outer(F.when(F.col("_card"), F.array("_level")).otherwise(F.col("_levels")))).where("_card or _level is not null")
    # direction, block and place in the direction; a card comes after the bar of its day
    at = lambda back, block, place: F.struct(F.lit(back).alias("back"), block.alias("block"), place.alias("place"))
    block = lambda c: F.expr(f"shiftright({c}, _level)")
    between = F.when(block("_to") - block("_from") == 2, at(False, block("_from") + 1, F.expr("shiftleft(shiftright(_from, _level) + 2, _level) - 1")))
    first = at(True, block("_from"), -F.col("_from"))
    met = F.when(F.col("_card"), F.array(first, at(False, block("_to"), F.col("_to")), between)).otherwise(F.array(first, at(False, block("_from"), F.col("_from"))))
    x = x.withColumn("_at", F.explode(met)).where("_at is not null").select("card_id", "symbol", "target", "stop", "high", "low", "_card", "_level", "_at.*")
    w = Window.partitionBy("symbol", "_level", "back", "block").orderBy("place", "_card").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"high": F.max("high").over(w), "low": F.min("low").over(w)}).where("_card")
    out = x.groupBy("card_id", "symbol", "target", "stop").agg(F.max("high").alias("max_price"), F.min("low").alias("min_price"))
    return out.withColumn("outcome", cascade((F.coalesce(F.col("max_price") >= F.col("target"), F.lit(False)), "SUCCESS"), (F.coalesce(F.col("min_price") <= F.col("stop"), F.lit(False)), "FAILURE"), otherwise="EXPIRED"))


def horizon_outcome_audit(df: DataFrame, n: int = 20) -> DataFrame:
    """First row of each symbol, the row n later (or the last), the return between and a verdict."""
    x = df.withColumn("_n", F.row_number().over(series())).where(F.col("_n") <= n + 1)
    out = x.groupBy("symbol").agg(F.min_by("close", "_n").alias("entry"), F.max_by("close", "_n").alias("exit"), F.max("date").alias("exit_date"))
    return out.withColumn("ret", F.col("exit") / F.col("entry") - 1).withColumn("verdict", cascade((F.col("ret") >= 0.075, "TARGET"), (F.col("ret") <= -0.04, "STOP"), otherwise="OPEN"))


def date_uniqueness(df: DataFrame) -> DataFrame:
    return df.withColumn("uniqueness", 1.0 / F.greatest(F.count("*").over(cross_section()), F.lit(1)))


def label_uniqueness(spans: DataFrame) -> DataFrame:
    """Mean inverse concurrency over each span (symbol, start_t, end_t inclusive, ret), and the weight with the return.

    Concurrency changes only where spans start or have ended: a sweep over these points counts it and sums its inverse up to
    each of them, and a span takes the difference between its two ends. Rows grow with the spans, not with their lengths. A
    repeated row is a span of its own: it counts as concurrent and comes back as often as it was given.
    """
    starts = spans.select("symbol", F.col("start_t").alias("t"), F.lit(1).alias("d"))
    ends = spans.select("symbol", (F.col("end_t") + 1).alias("t"), F.lit(-1).alias("d"))
    points = starts.unionByName(ends).groupBy("symbol", "t").agg(F.sum("d").alias("d"))
    w = series("symbol", "t")
    points = points.withColumn("c", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.when(F.col("c") > 0, (F.lead("t").over(w) - F.col("t")) / F.col("c"))
    upto = points.select("symbol", "t", step.alias("step")).withColumn("area", F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    at = lambda t, name: upto.select("symbol", F.col("t").alias(t), F.col("area").alias(name))
    x = spans.select("symbol", "start_t", "end_t", "ret", (F.col("end_t") + 1).alias("_end")).join(at("start_t", "_a"), ["symbol", "start_t"]).join(at("_end", "_b"), ["symbol", "_end"])
    x = x.withColumn("uniqueness", (F.col("_b") - F.col("_a")) / (F.col("_end") - F.col("start_t")))
    return x.select("symbol", "start_t", "end_t", "ret", "uniqueness", (F.col("uniqueness") * F.abs("ret")).alias("weight"))


def sample_weights(df: DataFrame, column: str = "fwd") -> DataFrame:
    """Weight by size of the return and uniqueness, halved for neutral labels, tripled for extreme returns."""
    base = (1 + F.abs(F.col(column))) * F.col("uniqueness")
    x = df.withColumn("opportunity", base)
    return x.withColumn("weight", F.col("opportunity") * cascade((F.col("label") == 0, 0.5), (F.abs(F.col(column)) >= 0.15, 3.0), otherwise=1.0))


def blended_sample(df: DataFrame, ratio: float = 0.8, history: int = 104, seed: int = 7) -> DataFrame:
    """The newest date and int(1 / (1 - ratio)) - 1 of the last `history` dates before it, drawn by hash."""
    k = int(round(1 / (1 - ratio))) - 1
    idx = dates_indexed(df)
    last = idx.agg(F.max("idx").alias("_last"))
    x = idx.join(last).withColumns({"_new": F.col("idx") == F.col("_last"), "_draw": F.row_number().over(Window.partitionBy((F.col("idx") == F.col("_last")) | (F.col("idx") < F.col("_last") - history)).orderBy(F.xxhash64("date", F.lit(seed)), "date"))})
    chosen = x.where(F.col("_new") | ((F.col("idx") >= F.col("_last") - history) & (F.col("_draw") <= k))).select("date", F.col("_new").alias("is_new"))
    return df.join(F.broadcast(chosen), "date")
