"""Ranking quality, attribution and portfolio accounting (E1 to E22). Tables: (date, symbol, score, actual)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import softrank
from tidepanel.functions.windows import average_rank, cascade, clip, correlation, cross_section, dates_indexed, series


def _place(score: str, *, up: bool = False) -> Column:
    return F.row_number().over(Window.partitionBy("date").orderBy(F.asc(score) if up else F.desc(score), "symbol"))


def ndcg_at_k(df: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    gain = F.pow(F.lit(2.0), F.greatest("actual", F.lit(0.0))) - 1
    x = df.withColumns({"_p": _place(score), "_a": _place("actual"), "_g": gain})
    part = lambda c: F.sum(F.when(F.col(c) <= k, F.col("_g") / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    out = x.groupBy("date").agg(part("_p").alias("dcg"), part("_a").alias("idcg"))
    return out.select("date", F.when(F.col("idcg") <= 1e-8, 1.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def spearman(df: DataFrame) -> DataFrame:
    x = df.withColumns({"_p": average_rank("score", "date"), "_a": average_rank("actual", "date")})
    out = x.groupBy("date").agg(correlation("_p", "_a").alias("c"), F.count("*").alias("n"))
    return out.select("date", F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("spearman"))


def root_cause(df: DataFrame, market: DataFrame, predicted: str = "score", sector: str = "asset_type") -> DataFrame:
    """Why predictions of a date failed: error, deviation, weights of a market shock, of sector noise and of ranking, clamped
    learning rate, and a summary of these figures.

    market: (date, market_return, market_vol). predicted names the predicted return, score ranks. Sectors of one asset do not
    count; neither do dates without market figures. (date, symbol) is a key.
    """
    x = df.withColumn("_e", F.col(predicted) - F.col("actual"))
    noise = x.groupBy("date", sector).agg(F.avg(F.abs("_e")).alias("m"), F.count("*").alias("n")).groupBy("date").agg(F.stddev_pop(F.when(F.col("n") > 1, F.col("m"))).alias("sector_std"))
    own = x.groupBy("date").agg(F.avg(F.abs("_e")).alias("mae"), F.stddev_pop("_e").alias("deviation"))
    out = own.join(noise, "date").join(ndcg_at_k(df), "date").join(spearman(df), "date").join(market, "date")
    # Limits 0.03 and 0.04, scales 0.05 and 0.06, floor 0.10, noise 0.5 and 0.2 at 0.02, rates 1e-6 to 1e-4
    move, vol = F.abs("market_return"), F.col("market_vol")
    out = out.withColumns({"shock": F.when((move > 0.03) | (vol > 0.04), F.least(F.lit(1.0), move / 0.05 + vol / 0.06)).otherwise(0.10), "sector_noise": F.when(F.col("sector_std") > 0.02, 0.5).otherwise(0.2)})
    out = out.withColumn("ranking_weight", F.greatest(F.lit(0.0), 1 - (0.5 * F.col("shock") + 0.3 * F.col("sector_noise"))) * (1 - F.greatest(F.lit(0.0), F.col("spearman"))))
    out = out.withColumn("learning_rate", clip(1e-4 * F.col("ranking_weight"), 1e-6, 1e-4))
    figures = F.format_string("shock %.1f %%, sector noise %.1f %%, ranking %.1f %%, NDCG@10 %.2f, Spearman %.2f", 100 * F.col("shock"), 100 * F.col("sector_noise"), 100 * F.col("ranking_weight"), F.col("ndcg"), F.col("spearman"))
    return out.select("date", "mae", "deviation", "shock", "sector_noise", "ranking_weight", "learning_rate", "ndcg", "spearman", figures.alias("summary"))


def topk_hits(df: DataFrame, k: int = 3) -> DataFrame:
    """Overlap of predicted and actual first and last k, and the points for it."""
    x = df.withColumns({"_pt": _place("score"), "_at": _place("actual"), "_pb": _place("score", up=True), "_ab": _place("actual", up=True)})
    both = lambda p, a: F.sum(F.when((F.col(p) <= k) & (F.col(a) <= k), 1).otherwise(0)).cast("int")
    out = x.groupBy("date").agg(both("_pt", "_at").alias("top_hits"), both("_pb", "_ab").alias("bottom_hits"))
    points = lambda c: cascade((F.col(c) >= 3, 100), (F.col(c) == 2, 50), (F.col(c) == 1, 10), otherwise=0)
    return out.withColumn("points", points("top_hits") + points("bottom_hits"))


def proximity_score(df: DataFrame) -> DataFrame:
    e = F.abs(F.col("score") - F.col("actual")) * 100
    return df.withColumn("proximity", cascade((e <= 1, 100), (e <= 3, 50), (e <= 5, 20), (e <= 10, 0), otherwise=-50))


def huber_proximity(df: DataFrame, at: float = 0.03) -> DataFrame:
    e = F.abs(F.col("score") - F.col("actual"))
    return df.groupBy("date").agg(F.avg(F.when(e < at, 0.5 * F.pow(e / at, 2)).otherwise(e / at - 0.5)).alias("huber"))


def _hinges(df: DataFrame, margin: float) -> DataFrame:
    """(date, n, hinges): sum over the pairs of a date of max(0, margin - sign(yi - yj) * (pi - pj)), without making pairs.

    A pair counts margin if its actuals tie, else how far the lower one's score plus margin is above the higher one's score.
    Assets get the dense rank of their actual; at each bit of it blocks have a lower and an upper half, and each pair meets in
    the one block whose halves part it. In a block, running sums in the order of scores give each upper asset the lower ones
    above it: n log n rows a date, and blocks lie in different tasks.
    """
    n = F.count("*").over(cross_section())
    x = df.select("date", (F.dense_rank().over(Window.partitionBy("date").orderBy("actual")) - 1).alias("r"), F.col("score").alias("p"), n.alias("n"))
    x = x.withColumn("bits", F.ceil(F.log2(F.max("r").over(cross_section()) + 1.0)).cast("int"))
    ties = x.groupBy("date", "r").agg(F.count("*").alias("c"), F.max("n").alias("n")).groupBy("date").agg(F.max("n").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("ties"))
    x = x.where("bits > 0").select("date", "r", "p", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit"))
    x = x.select("date", "bit", F.expr("shiftright(r, bit + 1)").alias("block"), (F.expr("shiftright(r, bit)") % 2 == 1).alias("upper"), "p")
    x = x.withColumn("key", F.when(F.col("upper"), F.col("p")).otherwise(F.col("p") + margin))
    above = Window.partitionBy("date", "bit", "block").orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    lower = F.when(~F.col("upper"), F.col("key"))
    x = x.withColumns({"s": F.sum(lower).over(above), "c": F.count(lower).over(above)})
    met = x.where("upper and c > 0").groupBy("date").agg(F.sum(F.col("s") - F.col("c") * F.col("p")).alias("h"))
    return ties.join(met, "date", "left").select("date", "n", (F.coalesce("h", F.lit(0.0)) + margin * F.col("ties")).alias("hinges"))


def pairwise_margin_loss(df: DataFrame, margin: float = 0.10) -> DataFrame:
    """Mean over the pairs of a date of how far scores miss the order of actuals by a margin; dates of one asset have none."""
    x = _hinges(df, margin).where("n > 1")
    return x.select("date", (F.col("hinges") / (F.col("n") * (F.col("n") - 1) / 2)).alias("pair_loss"))


def triplet_tail_loss(df: DataFrame, margin: float = 0.10, tail_margin: float = 0.20) -> DataFrame:
    """Pair loss plus hinges that keep the actual best three above the fourth and the worst three below; 0 below 6 assets."""
    x = df.withColumns({"_t": _place("actual"), "_b": _place("actual", up=True)})
    at = lambda fn, ok: fn(F.when(ok, F.col("score")))
    out = x.groupBy("date").agg(at(F.min, F.col("_t") <= 3).alias("worst_top"), at(F.max, F.col("_t") == 4).alias("fourth"), at(F.max, F.col("_b") <= 3).alias("best_bottom"), at(F.min, F.col("_b") == 4).alias("fourth_bottom"), F.count("*").alias("n"))
    out = out.join(pairwise_margin_loss(df, margin), "date", "left")
    hinge = F.greatest(F.lit(0.0), tail_margin + F.col("fourth") - F.col("worst_top")) + F.greatest(F.lit(0.0), tail_margin + F.col("best_bottom") - F.col("fourth_bottom"))
    return out.select("date", F.when(F.col("n") < 6, 0.0).otherwise(F.col("pair_loss") + hinge).alias("tail_loss"))


#: Clamp of a scaled score difference, and the least temperature (fixed values).
CLAMP, LEAST_TAU = 10.0, 0.10


def soft_ndcg_loss(df: DataFrame, tau: float = 0.05, eta: float = 1.0) -> DataFrame:
    """Differentiable ranking loss as a metric per date, for risers and fallers alike.

    Soft ranks are sums of logistics of clamped differences of standardised scores at temperature tau, at least LEAST_TAU.
    Relevance runs from 0 to 5 by the place of the actual (ties by symbol), in both directions; gains near rank 1 are boosted.
    Added are a logistic of the scores of crashed assets, a penalty on the spread of scores and one on dominance.
    The sums over the pairs of a date are those of functions/softrank.py, whose work grows with a date's assets.
    """
    w, tau = cross_section(), max(tau, LEAST_TAU)
    z = (F.col("score") - F.avg("score").over(w)) / (F.stddev_pop("score").over(w) + 1e-5)
    n = F.count("*").over(w)
    share = (_place("actual", up=True) - 1) / F.greatest(n - 1, F.lit(1))
    top = F.exp(F.col("score") - F.max("score").over(w))
    x = df.select("date", "symbol", "score", z.alias("z"), share.alias("share"), (F.col("actual") <= -0.90).alias("crashed"), top.alias("_e"), n.alias("n"))
    # an asset meets itself with a half; what a logistic lacks to 1 is that of the other direction
    soft = softrank.logistic_sums(x.select("date", "symbol", "z"), tau, CLAMP).select("date", "symbol", (F.col("total") + 0.5).alias("soft"))
    x = x.join(soft, ["date", "symbol"]).withColumn("reverse", F.col("n") + 1 - F.col("soft"))
    parts = []
    for rank, grade, name in (("soft", 5 * F.col("share"), "up"), ("reverse", 5 * (1 - F.col("share")), "down")):
        gain = F.pow(F.lit(2.0), grade) - 1
        boost = 1 + 4 * F.exp(-0.8 * F.pow(F.col(rank) - 1, 2))
        place = F.col("n") - F.round(F.col("share") * (F.col("n") - 1)) if name == "up" else F.round(F.col("share") * (F.col("n") - 1)) + 1
        parts += [F.sum(gain / F.log2(F.col(rank) + 1) * boost).alias(f"dcg_{name}"), F.sum(gain / F.log2(place + 1.0)).alias(f"idcg_{name}")]
    push = F.sum(F.when(F.col("crashed"), 1 / (1 + F.exp(-F.col("score")))).otherwise(0.0))
    out = x.groupBy("date").agg(*parts, push.alias("push"), F.stddev_pop("score").alias("std"), (F.max("_e") / F.sum("_e")).alias("most"))
    side = lambda k: 1 - F.col(f"dcg_{k}") / F.greatest(F.col(f"idcg_{k}"), F.lit(1e-6))
    return out.select("date", (0.5 * (side("up") + side("down")) + eta * F.col("push") + 0.5 * F.pow(F.col("std") - 1, 2) + 2 * F.greatest(F.col("most") - 0.15, F.lit(0.0))).alias("soft_loss"))


def trajectory_error(df: DataFrame, n: int = 21) -> DataFrame:
    """Mean over the next n dates of the mean absolute difference between a date's score and the later actuals."""
    idx = dates_indexed(df)
    x = df.join(idx, "date")
    later = x.select("symbol", F.explode(F.sequence(F.col("idx") - n, F.col("idx") - 1)).alias("from"), F.col("idx").alias("to"), F.col("actual").alias("y"))
    met = x.select("symbol", F.col("idx").alias("from"), "date", "score").join(later, ["symbol", "from"])
    step = met.groupBy("date", "to").agg(F.avg(F.abs(F.col("score") - F.col("y"))).alias("e"))
    return step.groupBy("date").agg(F.avg("e").alias("trajectory"), F.count("*").alias("steps"))


def rank_report(df: DataFrame) -> DataFrame:
    return df.withColumns({"predicted_rank": _place("score"), "actual_rank": _place("actual")}).withColumn("rank_gap", F.col("predicted_rank") - F.col("actual_rank"))


def monthly_signal_audit(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Decisions (symbol, date, code) against the return over the next rows (fwd): calls, hits and accuracy per symbol."""
    x = signals.join(bars.select("symbol", "date", "fwd"), ["symbol", "date"])
    hit = ((F.col("code") == 1) & (F.col("fwd") > 0)) | ((F.col("code") == -1) & (F.col("fwd") < 0))
    out = x.where("code <> 0").groupBy("symbol").agg(F.count("*").alias("calls"), F.sum(hit.cast("int")).cast("long").alias("hits"))
    return out.withColumn("accuracy", F.col("hits") / F.col("calls"))


def topn_vs_universe(df: DataFrame, n: int = 10) -> DataFrame:
    """Mean actual of the n best scores, of the universe and the spread, per date."""
    x = df.withColumn("_p", _place("score"))
    out = x.groupBy("date").agg(F.avg(F.when(F.col("_p") <= n, F.col("actual"))).alias("top_mean"), F.avg("actual").alias("universe_mean"))
    return out.withColumn("spread", F.col("top_mean") - F.col("universe_mean"))


def noise_sensitivity(df: DataFrame, size: float = 0.5, seed: int = 11) -> DataFrame:
    """Drop of the mean ranking quality when scores get noise of `size` deviations, drawn from a hash of the row."""
    u = (F.pmod(F.xxhash64("date", "symbol", F.lit(seed)), F.lit(1 << 20)) + 1) / float((1 << 20) + 1)
    v = (F.pmod(F.xxhash64("symbol", "date", F.lit(seed + 1)), F.lit(1 << 20)) + 1) / float((1 << 20) + 1)
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)
    s = F.stddev_pop("score").over(cross_section())
    noisy = df.withColumn("score", F.col("score") + size * s * normal)
    both = ndcg_at_k(df).agg(F.avg("ndcg").alias("clean")).join(ndcg_at_k(noisy).agg(F.avg("ndcg").alias("noisy")))
    return both.withColumn("drop", F.col("clean") - F.col("noisy"))


def portfolio_return(weights: DataFrame) -> DataFrame:
    """Sum of weight times return per (portfolio, step), and the equal-weight benchmark."""
    r = F.coalesce("ret", F.lit(0.0))
    return weights.groupBy("portfolio", "step").agg(F.sum(F.col("weight") * r).alias("ret"), F.avg(r).alias("bm_ret"))


def turnover(weights: DataFrame) -> DataFrame:
    """Sum of absolute changes of weights per step; an absent asset has weight 0, the first step counts from 0."""
    steps = weights.select("portfolio", "step").distinct()
    order = steps.withColumn("next", F.lead("step").over(Window.partitionBy("portfolio").orderBy("step")))
    now = weights.select("portfolio", "step", "symbol", F.col("weight").alias("w"), F.lit(0.0).alias("before"))
    gone = weights.join(order, ["portfolio", "step"]).where("next is not null").select("portfolio", F.col("next").alias("step"), "symbol", F.lit(0.0).alias("w"), F.col("weight").alias("before"))
    both = now.unionByName(gone).groupBy("portfolio", "step", "symbol").agg(F.sum("w").alias("w"), F.sum("before").alias("before"))
    return both.groupBy("portfolio", "step").agg(F.sum(F.abs(F.col("w") - F.col("before"))).alias("turnover"))


def trade_costs(weights: DataFrame, penalty: DataFrame, capital: float = 1e6, rate: float = 0.002) -> DataFrame:
    """Impact, settlement and turnover costs per (portfolio, step); penalty: symbol, impact, settlement."""
    x = weights.join(penalty.select("symbol", "impact", "settlement"), "symbol", "left").fillna(0.0, ["impact", "settlement"])
    out = x.groupBy("portfolio", "step").agg(F.sum(F.col("weight") ** 2 * F.col("impact")).alias("impact_cost"), (F.sum(F.abs(F.col("weight") * F.col("settlement"))) * capital).alias("settlement_cost"))
    return out.join(turnover(weights), ["portfolio", "step"]).withColumn("turnover_cost", rate * F.col("turnover"))


def nav_curve(returns: DataFrame) -> DataFrame:
    """Cumulative product of 1 + return for portfolio and benchmark; zero from the step that loses all."""
    w = Window.partitionBy("portfolio").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)

    def grown(c):
        ruined = F.max((F.col(c) <= -1).cast("int")).over(w) == 1
        return F.when(ruined, 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(F.col(c) > -1, F.col(c)).otherwise(0.0))).over(w)))

    return returns.withColumns({"nav": grown("ret"), "bm_nav": grown("bm_ret")})


def portfolio_stats(returns: DataFrame, per_year: float = 12.0) -> DataFrame:
    """Largest drawdown, Sharpe, yearly growth and excess over the benchmark per portfolio."""
    w = Window.partitionBy("portfolio").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    x = nav_curve(returns).withColumn("_dd", 1 - F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)))
    out = x.groupBy("portfolio").agg(F.max("_dd").alias("max_drawdown"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.max_by("nav", "step").alias("nav"), F.max_by("bm_nav", "step").alias("bm"), F.count("*").alias("n"))
    growth = lambda c: F.pow(F.col(c), per_year / F.col("n")) - 1
    return out.select("portfolio", "max_drawdown", F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * per_year**0.5).otherwise(0.0).alias("sharpe"), growth("nav").alias("cagr"), (growth("nav") - growth("bm")).alias("alpha"))


#: What sums of weights may be off by rounding.
SLACK = 1e-9


def weight_limits_check(weights: DataFrame, most: float = 0.35, budget: float = 1.0) -> DataFrame:
    """Violations of box, long-only and budget limits: (portfolio, step, symbol or null, rule, value)."""
    box = weights.where(F.col("weight") > most).select("portfolio", "step", "symbol", F.lit("box").alias("rule"), F.col("weight").alias("value"))
    short = weights.where(F.col("weight") < 0).select("portfolio", "step", "symbol", F.lit("long only").alias("rule"), F.col("weight").alias("value"))
    total = weights.groupBy("portfolio", "step").agg(F.sum("weight").alias("value")).where(F.abs(F.col("value") - budget) > 1e-6)
    return box.unionByName(short).unionByName(total.select("portfolio", "step", F.lit(None).cast(weights.schema["symbol"].dataType).alias("symbol"), F.lit("budget").alias("rule"), "value"))


def group_limits_check(weights: DataFrame, limits: DataFrame, group: str) -> DataFrame:
    """Violations of the least and most total weight of each group: (portfolio, step, symbol null, group, rule, value).

    limits: a row (group, least, most) for each limited group; a group without weights at a step has the total 0.
    """
    held = weights.groupBy("portfolio", "step", group).agg(F.sum("weight").alias("value"))
    every = weights.select("portfolio", "step").distinct().join(F.broadcast(limits.select(F.collect_list(F.struct(group, "least", "most")).alias("limits"))))
    every = every.select("portfolio", "step", F.explode("limits").alias("x")).select("portfolio", "step", "x.*")
    met = every.join(held, ["portfolio", "step", group], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    met = met.withColumn("rule", cascade((F.col("value") > F.col("most") + SLACK, "group max"), (F.col("value") < F.col("least") - SLACK, "group min"))).where("rule is not null")
    return met.select("portfolio", "step", F.lit(None).cast(weights.schema["symbol"].dataType).alias("symbol"), group, "rule", "value")


def turnover_check(weights: DataFrame, most: float) -> DataFrame:
    """Steps after a portfolio's first one at which the absolute changes of its weights add up to more than `most`."""
    steps = weights.select("portfolio", "step").distinct().withColumn("after", F.lead("step").over(Window.partitionBy("portfolio").orderBy("step")))
    steps = steps.withColumn("first", F.min("step").over(Window.partitionBy("portfolio")))
    w = weights.select("portfolio", "step", "symbol", "weight").join(steps, ["portfolio", "step"])
    sides = F.array(F.struct("step", "weight"), F.struct(F.col("after").alias("step"), (-F.col("weight")).alias("weight")))
    moved = w.select("portfolio", "symbol", "first", F.explode(sides).alias("x")).select("portfolio", "symbol", "first", "x.*").where("step > first")
    moved = moved.groupBy("portfolio", "step", "symbol").agg(F.abs(F.sum("weight")).alias("d")).groupBy("portfolio", "step").agg(F.sum("d").alias("value"))
    return moved.where(F.col("value") > most + SLACK).select("portfolio", "step", F.lit(None).cast(weights.schema["symbol"].dataType).alias("symbol"), F.lit("turnover").alias("rule"), "value")


def run_stats(weights: DataFrame) -> DataFrame:
    active = F.sum((F.abs("weight") > 1e-6).cast("int")).cast("long")
    return weights.groupBy("portfolio", "step").agg(active.alias("active"), F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight"), F.sum("weight").alias("total"))


def classification_metrics(df: DataFrame) -> DataFrame:
    """Accuracy and spread of the probabilities from (symbol, label, predicted, p_success)."""
    return df.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.min("p_success").alias("p_min"), F.max("p_success").alias("p_max"), F.stddev_pop("p_success").alias("p_std"), F.count_distinct("symbol").alias("n_symbols"), F.count("*").alias("n_rows"))
