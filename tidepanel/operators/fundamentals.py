"""Fundamental scores, one row per ticker and date (V1 to V8); every score is a set of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.windows import cascade, clip
from tidepanel.operators.crosssec import history_zscore, sector_median

# Sector codes by region key that count as cyclical and as retail.
CYCLICAL, RETAIL = (1, 3), (2,)


def _bands(score: Column, *bands: tuple[float, str], low: str) -> Column:
    return cascade(*[(score >= least, label) for least, label in bands], otherwise=low)


_FOUR = ((0.75, "BULLISH"), (0.60, "MODERATE_BULLISH"), (0.40, "NEUTRAL"))


def _unit(c: Column) -> Column:
    # points are hundredths; rounding keeps sums such as 0.5 + 0.15 - 0.05 on their band
    return F.round(clip(c, 0, 1), 6)


def pe_score(df: DataFrame) -> DataFrame:
    """Raw and adjusted price-earnings, yield, growth ratio, relative multiple, premium, z, flags, score, confidence, label.

    Sector medians and five-year history come from the table itself. One-off income is taken off, one-off expenses (a column
    that may be missing) are added back.
    """
    mc, ni = F.col("market_cap"), F.col("net_income")
    wins = lambda c: F.greatest(F.lit(1.0), F.least(F.lit(500.0), c))
    expense = F.coalesce("one_off_expense", F.lit(0.0)) if "one_off_expense" in df.columns else F.lit(0.0)
    adj = ni - F.col("one_off_income") + expense
    negative = (ni <= 0) | (mc <= 0)
    x = df.withColumns({"negative": negative, "raw_pe": F.when(~negative, wins(mc / ni)), "adjusted_pe": F.when((adj > 0) & (mc > 0), wins(mc / adj))})
    x = x.withColumn("pe", F.coalesce("adjusted_pe", "raw_pe"))
    x = history_zscore(sector_median(x, "pe"), "pe")
    x = x.withColumns(
        {
            "earnings_yield": F.when(F.col("negative"), F.when(mc > 0, ni / mc).otherwise(0.0)).otherwise(1 / F.col("raw_pe")),
            "peg": F.col("pe") / F.greatest(F.lit(0.1), F.col("growth_pct")),
            "pe_rel": F.when(F.col("pe").isNotNull() & (F.col("sector_pe") > 0), F.col("pe") / F.col("sector_pe")).otherwise(1.0),
            "erp": F.when(F.col("pe").isNotNull(), 1 / F.col("pe") - F.col("risk_free")).otherwise(-F.col("risk_free")),
            "leverage": F.col("net_debt") / F.greatest(F.lit(1.0), F.col("ebitda")),
            "pe_z": F.when(F.col("pe").isNotNull(), F.col("pe_z")).otherwise(0.0),
            "cyclical": F.col("sector").isin(*CYCLICAL),
            "one_off": F.col("one_off_income") > 0,
        }
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumns({"debt_trap": F.col("leverage") > 5, "distressed": no(F.col("pe") < 3) & F.col("one_off"), "bubble": no((F.col("pe") > 1.5 * F.col("sector_pe")) & (F.col("peg") > 2))})
    rel, erp = F.col("pe_rel"), F.col("erp")
    cheap = no(F.col("peg") < 1)
    strong = (rel < 0.8) & cheap & (F.col("leverage") < 2)
    cyclic = F.col("cyclical") & (F.col("one_off") | (rel > 1.2))
    points = 0.5 + cascade((rel < 0.8, 0.15), (rel > 1.5, -0.20), otherwise=0.0) + F.when((F.col("risk_free") > 0.20) & (rel > 1.2), -0.15).otherwise(0.0) + cascade((erp > 0.05, 0.05), (erp < 0, -0.05), otherwise=0.0)
    points = _unit(points)
    pick = lambda *v: cascade((F.col("negative"), v[0]), (F.col("bubble"), v[1]), (F.col("distressed") | F.col("debt_trap"), v[2]), (strong, v[3]), (cheap, v[4]), (cyclic, v[5]), otherwise=v[6])
    return x.withColumns(
        {
            "score": pick(0.15, 0.20, 0.25, 0.85, F.when(erp > 0, 0.80).otherwise(0.75), 0.32, points),
            "confidence": pick(0.90, 0.92, 0.88, 0.95, 0.90, 0.88, 0.88),
            "label": pick("BEARISH_NEGATIVE_EARNINGS", "SELL_BUBBLE_PRICING", "BEARISH_VALUE_TRAP", "STRONG_BUY", "BUY", "NEUTRAL_TO_BEARISH", _bands(points, (0.75, "STRONG_BUY"), (0.60, "BUY"), (0.40, "NEUTRAL"), (0.25, "NEUTRAL_TO_BEARISH"), low="SELL")),
        }
    )


def pb_score(df: DataFrame, cost_of_equity: float = 0.25, growth: float = 0.05) -> DataFrame:
    """Raw, tangible and justified price-to-book, discount, flags, score and label."""
    mc, bv, roe = F.col("market_cap"), F.col("equity"), F.col("net_income") / F.col("equity")
    wins = lambda c: F.greatest(F.lit(0.1), F.least(F.lit(100.0), c))
    tangible = bv - F.col("goodwill") - F.col("intangibles") - F.col("deferred_tax")
    dead = (bv <= 0) | (mc <= 0)
    x = df.withColumns({"negative_equity": dead, "roe": F.when(~dead, roe), "raw_pb": F.when(~dead, wins(mc / bv)), "tangible_pb": F.when(~dead & (tangible > 0), wins(mc / tangible)), "_tbv": tangible})
    x = x.withColumn("justified_pb", F.when(~dead, F.greatest(F.lit(0.2), (F.col("roe") - growth) / max(0.01, cost_of_equity - growth))))
    x = x.withColumn("discount", F.when(dead, 0.0).otherwise((F.col("justified_pb") - F.col("raw_pb")) / F.col("justified_pb")))
    low, roe = F.col("raw_pb") < 1, F.col("roe")
    no = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumns({"goodwill_trap": no(~dead & ((F.col("_tbv") <= 0) | (low & (F.col("tangible_pb") > 2)))), "value_trap": no(low & (roe < cost_of_equity)), "tangible_discount": no(low & (roe >= cost_of_equity) & (F.col("tangible_pb") < 1)), "hidden_assets": no(~dead & ((F.col("revaluation") > 0) | (F.col("discount") > 0.20))), "leverage_risk": no((F.col("net_debt") > 0) & (F.col("_tbv") > 0) & (F.col("net_debt") / F.col("_tbv") > 3))})
    strong = F.col("tangible_discount") & (roe > 1.2 * cost_of_equity) & ~F.col("leverage_risk")
    points = _unit(0.5 + cascade((F.col("discount") > 0.25, 0.20), (F.col("discount") < -0.30, -0.20), otherwise=0.0) + F.when(F.col("hidden_assets"), 0.10).otherwise(0.0))
    pick = lambda *v: cascade((F.col("negative_equity"), v[0]), (F.col("goodwill_trap"), v[1]), (F.col("value_trap"), v[2]), (strong, v[3]), otherwise=v[4])
    return x.withColumns({"score": pick(0.10, 0.25, 0.30, 0.88, points), "label": pick("SOLVENCY_DISTRESS_RISK", "BEARISH_GOODWILL_TRAP", "BEARISH_VALUE_TRAP", "STRONG_BUY", _bands(points, *_FOUR, low="BEARISH"))}).drop("_tbv")


def ebitda_score(df: DataFrame) -> DataFrame:
    """Raw and adjusted EBITDA, margin, cash conversion, leverage, five flags, score and label."""
    x = df.withColumn("raw_ebitda", F.col("ebit") + F.col("depreciation"))
    x = x.withColumn("adjusted_ebitda", F.greatest(F.lit(0.01), F.col("raw_ebitda") - F.col("leases") - F.col("stock_pay") - F.col("capitalised_capex")))
    share = lambda c, most: (F.col("raw_ebitda") > 0) & (F.col(c) / F.col("raw_ebitda") > most)
    x = x.withColumns({"margin": F.col("adjusted_ebitda") / F.greatest(F.lit(1.0), F.col("revenue")), "conversion": (F.col("operating_cash") - F.col("capex")) / F.col("adjusted_ebitda"), "leverage": F.col("net_debt") / F.col("adjusted_ebitda"), "lease_distortion": share("leases", 0.10), "pay_dilution": share("stock_pay", 0.05), "capex_warning": share("capitalised_capex", 0.03)})
    x = x.withColumns({"decoupling": F.col("conversion") < 0.30, "high_leverage": F.col("leverage") > 4, "turnaround": (F.col("net_income") < 0) & (F.col("leverage") < 4)})
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    points = 0.60 + part(F.col("conversion") >= 0.40, 0.15) + part(F.col("margin") > 0.10, 0.10) + cascade((F.col("leverage") < 3, 0.05), (F.col("leverage") > 4, -0.15), otherwise=0.0) + part(F.col("capex_warning"), -0.05) + part(F.col("lease_distortion"), -0.04) + part(F.col("pay_dilution"), -0.10)
    points = _unit(points)
    pick = lambda *v: cascade((F.col("decoupling"), v[0]), (F.col("turnaround"), v[1]), otherwise=v[2])
    return x.withColumns({"score": pick(0.18, 0.78, points), "label": pick("VALUE_TRAP_NO_CASH_CONVERSION", "TURNAROUND_BUY", _bands(points, *_FOUR, low="BEARISH"))})


def ev_score(df: DataFrame) -> DataFrame:
    """Enterprise value and its multiples, leverage, four flags, score and label; sector medians from the table.

    Needs market_cap, gross_debt, leases, cash, restricted_cash, associates, minority, ebitda and capex. Restricted cash is no
    cash, associates are taken off, a fifth of minority interest is added.
    """
    free_cash = F.col("cash") - F.col("restricted_cash")
    ev = F.col("market_cap") + F.col("gross_debt") + F.col("leases") - free_cash - F.col("associates") + 0.20 * F.col("minority")
    x = df.withColumns({"ev": ev, "restricted_cash_adjusted": F.col("restricted_cash") > 0, "_gross": F.col("gross_debt"), "_e": F.col("ebitda")})
    ok = F.col("_e") > 0
    x = x.withColumns({"ev_ebitda": F.when(ok, F.col("ev") / F.col("_e")), "ev_after_capex": F.when(ok, F.when(F.col("_e") > F.col("capex"), F.col("ev") / (F.col("_e") - F.col("capex"))).otherwise(999.0)), "ev_leverage": F.col("_gross") / F.greatest(F.lit(1.0), F.when(ok, F.abs("ev")).otherwise(F.col("ev")))})
    x = sector_median(x, "ev_ebitda")
    m, med = F.col("ev_ebitda"), F.col("sector_ev_ebitda")
    no = lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumns({"net_cash": ok & (F.col("ev") < 0), "capex_trap": no(F.col("ev_after_capex") / F.greatest(F.lit(0.1), m) > 2.5)})
    x = x.withColumn("takeover_target", no(m < 0.75 * med) & ~F.col("capex_trap"))
    points = _unit(0.5 + cascade((m < 0.85 * med, 0.15), (m > 1.40 * med, -0.20), otherwise=0.0) + F.when(F.col("takeover_target"), 0.10).otherwise(0.0) + F.when(F.col("ev_leverage") > 0.60, -0.15).otherwise(0.0))
    pick = lambda *v: cascade((~ok, v[0]), (F.col("net_cash"), v[1]), (F.col("capex_trap"), v[2]), ((m < 0.70 * med) & (F.col("ev_leverage") < 0.5), v[3]), otherwise=v[4])
    return x.withColumns({"score": pick(0.15, 0.95, 0.22, 0.86, points), "label": pick("CASH_BURN_RED_FLAG", "STRONG_BUY_NET_NET_LIQUIDATION", "BEARISH_CAPEX_TRAP", "BULLISH", _bands(points, *_FOUR, low="BEARISH"))}).drop("_gross", "_e")


def roe_score(df: DataFrame, inflation: float = 0.10, payout: float = 0.3, cost_of_equity: float = 0.25) -> DataFrame:
    """Return on average equity (four quarters back), core and real return, five-part breakdown, driver, growth, flags."""
    before = F.coalesce(F.lag("equity", 4).over(Window.partitionBy("ticker").orderBy("as_of")), F.col("equity"))
    x = df.withColumn("avg_equity", (F.col("equity") + before) / 2)
    ok, e = F.col("avg_equity") > 0, F.col("ebit")
    ebt = F.when(e > 0, 0.92 * e).otherwise(e)
    rev, assets = F.greatest(F.lit(1.0), F.col("revenue")), F.greatest(F.lit(1.0), F.col("total_assets"))
    when = lambda c: F.when(ok, c)
    x = x.withColumns({"raw_roe": when(F.col("net_income") / F.col("avg_equity")), "core_roe": when((F.col("net_income") - F.col("one_off_income")) / F.col("avg_equity")), "tax_burden": when(F.when(ebt > 0, F.col("net_income") / ebt).otherwise(0.85)), "interest_burden": when(F.when(e > 0, ebt / e).otherwise(0.92)), "ebit_margin": when(e / rev), "turnover": when(rev / assets), "leverage": when(assets / F.col("avg_equity"))})
    x = x.withColumns({"real_roe": F.col("core_roe") - inflation, "sgr": F.col("core_roe") * (1 - payout), "driver": cascade((~ok, "DOUBLE_NEGATIVE_BANKRUPTCY"), (F.col("leverage") > 5, "LEVERAGE_DRIVEN"), (F.col("turnover") > 2, "ASSET_TURNOVER_DRIVEN"), (F.col("ebit_margin") > 0.15, "MOAT_MARGIN_DRIVEN"), otherwise="BALANCED")})
    x = x.withColumns({"justified_pb": when(F.greatest(F.lit(0.2), (F.col("core_roe") - F.col("sgr")) / F.greatest(F.lit(0.01), cost_of_equity - F.col("sgr")))), "double_negative": ~ok, "destruction": ~ok | (F.col("real_roe") < 0), "leverage_risk": F.coalesce(F.col("leverage") > 5, F.lit(False))})
    base = F.when((F.col("core_roe") > cost_of_equity) & (F.col("leverage") < 4), 0.85).otherwise(0.5)
    points = _unit(base + F.when(F.col("real_roe") > 0.15, 0.07).otherwise(0.0) + F.when(F.col("driver").isin("ASSET_TURNOVER_DRIVEN", "MOAT_MARGIN_DRIVEN"), 0.05).otherwise(0.0))
    pick = lambda *v: cascade((~ok, v[0]), (F.col("leverage_risk"), v[1]), (F.col("destruction"), v[2]), otherwise=v[3])
    return x.withColumns({"score": pick(0.10, 0.20, 0.25, points), "label": pick("DOUBLE_NEGATIVE_BANKRUPTCY_TRAP", "BEARISH_HIGH_LEVERAGE_ROE", "CAPITAL_DESTRUCTION_TRAP", _bands(points, *_FOUR, low="BEARISH"))})


def liquidity_score(df: DataFrame) -> DataFrame:
    """Current, adjusted, quick and cash ratios, working capital, four flags, score and label."""
    cl = F.greatest(F.lit(1.0), F.col("current_liabilities"))
    ca = F.col("current_assets")
    clean = ca - F.col("related_receivables") - F.col("doubtful_receivables")
    x = df.withColumns({"current_ratio": ca / cl, "adjusted_ratio": clean / cl, "quick_ratio": (clean - F.col("inventories")) / cl, "cash_ratio": F.col("cash") / cl, "working_capital": ca - cl, "_cfo": F.col("operating_cash") / cl})
    a, q = F.col("adjusted_ratio"), F.col("quick_ratio")
    retail = F.col("sector").isin(*RETAIL) & (a >= 0.75)
    heavy = (a > 1.1) & (q < 0.85)
    x = x.withColumns({"related_risk": F.col("related_receivables") / F.greatest(F.lit(1.0), ca) > 0.15, "inventory_heavy": heavy, "retail_exception": retail, "distress": ~retail & (a < 1)})
    critical = ~retail & (a < 1) & (F.col("cash_ratio") < 0.15) & (F.col("_cfo") < 0.10)
    good = (a >= 1.5) & (q >= 1)
    pick = lambda *v: cascade((critical, v[0]), (retail, v[1]), (good & heavy, v[2]), (good, v[3]), (a >= 1.2, v[4]), (a >= 1, v[5]), otherwise=v[6])
    return x.withColumns({"score": pick(0.08, 0.75, 0.79, 0.89, 0.68, 0.45, 0.20), "label": pick("CRITICAL_LIQUIDITY_RISK", "NEUTRAL", "NEUTRAL", "BULLISH", "NEUTRAL", "BEARISH_LIQUIDITY_WARNING", "CRITICAL_LIQUIDITY_RISK")}).drop("_cfo")


def rate_regime(df: DataFrame, rf: str = "risk_free") -> DataFrame:
    high, zero = F.col(rf) > 0.20, F.col(rf) < 0.03
    pick = lambda *v: cascade((high, v[0]), (zero, v[1]), otherwise=v[2])
    return df.withColumns({"regime": pick("HIGH_INTEREST_RATE", "ZERO_INTEREST_RATE", "NORMAL_RATE"), "pe_penalty": pick(1.8, 0.5, 1.0), "growth_tolerance": pick(0.6, 1.5, 1.0)})


def feedback_rmse_weights(df: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """Error over the last ten feedback rows (score, actual) and the weights after each: every breach moves 0.05."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.withColumns({"_e": F.pow(F.col("actual") - (F.col("score") - 0.5) * 0.4, 2), "_n": F.row_number().over(w)})
    x = x.withColumn("rmse", F.when(F.col("_n") >= 10, F.sqrt(F.avg("_e").over(w.rowsBetween(-9, 0)))))
    x = x.withColumn("breaches", F.sum(F.when(F.col("rmse") > 0.15, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumns({"pe_weight": F.greatest(F.lit(0.15), 0.40 - 0.05 * F.col("breaches")), "ev_weight": 0.35 + 0.025 * F.col("breaches"), "fcf_weight": 0.25 + 0.025 * F.col("breaches")}).drop("_e", "_n")
