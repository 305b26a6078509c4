"""Queries for risk operators over all Fridays; the SQL looks at each snapshot's rows anew where that is affordable."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import snapshots
from tidepanel.plans.queries_data import BY, EPS, NAV
from tidepanel.plans.registry import add


def fridays(v):
    return v("daily_bars").where("dayofweek(date) = 6").select(F.col("date").alias("snapshot_time"), F.date_sub("date", 1).alias("nav_cutoff")).distinct()


SNAPS = f"""snaps AS (SELECT DISTINCT date AS t, CAST(date - 1 AS DATE) AS c FROM daily_bars WHERE isodow(date) = 5),
lr AS (SELECT *, {NAV} AS nav, ln(close / lag(close) OVER ({BY})) AS ret FROM daily_bars)"""
STATE = f"""{SNAPS}, vis AS (SELECT s.t, lr.*, row_number() OVER (PARTITION BY s.t, symbol ORDER BY date DESC) AS k, avg(ret) OVER (PARTITION BY s.t, symbol) AS m
 FROM lr JOIN snaps s ON date <= CASE WHEN nav THEN s.c ELSE s.t END),
ag AS (SELECT t, symbol, asset_type, nav, count(*) AS n, count(ret) AS nr, greatest(sqrt(avg(CASE WHEN high > 0 AND low > 0 AND high >= low THEN ln(high / low) ** 2 END) / (4 * ln(2))) * sqrt(252), 1e-4) AS park,
 CASE WHEN count(ret) < 5 THEN 1e-4 ELSE greatest(sqrt(sum(0.94 ** (k - 1) * (ret - m) ** 2 * CASE WHEN ret < 0 THEN 1.2 ELSE 0.8 END) / sum(CASE WHEN ret IS NOT NULL THEN 0.94 ** (k - 1) END)) * sqrt(252), 1e-4) END AS ewma,
 stddev_samp(ret) FILTER (k <= 30) AS s30, avg(CASE WHEN volume > 0 THEN least(1, greatest(0, auction_volume / volume)) ELSE 0 END) FILTER (k <= 20) AS au, least(20, count(*)) AS days FROM vis GROUP BY 1, 2, 3, 4),
st AS (SELECT t AS snapshot_time, symbol, asset_type, CASE WHEN nav THEN 1 ELSE greatest(au, 1e-6) END AS auction_ratio, CASE WHEN nav THEN 0 ELSE days END AS days_used, NOT nav AND au < 1e-6 AS is_floored,
 CASE WHEN nav THEN CASE WHEN nr < 10 THEN fl ELSE greatest(0.5 * s30 * sqrt(252) + 0.5 * ewma, fl) END WHEN n < 2 THEN 1e-4 ELSE greatest(0.5 * ewma + 0.5 * coalesce(park, 1e-4), 1e-4) END AS vol,
 CASE WHEN nav THEN nr < 10 ELSE n < 2 END AS is_fallback FROM (SELECT *, CASE asset_type WHEN 'TEFAS_FREE' THEN 0.005 ELSE 1e-4 END AS fl FROM ag) a)"""
# returns with the snapshots that see them first: en by the row's own class, ne where a NAV row is part of a pair
ENTER = """ds AS (SELECT d.date, min(s.t) AS ft FROM (SELECT DISTINCT date FROM lr) d LEFT JOIN snaps s ON s.t >= d.date GROUP BY 1),
dn AS (SELECT d.date, min(s.t) AS nt FROM (SELECT DISTINCT date FROM lr) d LEFT JOIN snaps s ON s.c >= d.date GROUP BY 1),
e AS (SELECT symbol, date, ret, nav, CASE WHEN nav THEN nt ELSE ft END AS en, nt AS ne FROM lr JOIN ds USING (date) JOIN dn USING (date) WHERE ret IS NOT NULL)"""
KAP = """gi AS (SELECT date, en, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date, en FROM e WHERE NOT nav) x),
fi AS (SELECT symbol, ret, gi.en, i FROM e JOIN gi USING (date) WHERE NOT nav),
gt AS (SELECT s.t, count(gi.date) AS g FROM snaps s LEFT JOIN gi ON gi.en <= s.t GROUP BY 1),
ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
lag_k AS (SELECT a.symbol, a.i, k, a.en, a.ret AS y, coalesce(b.ret, 0) * a.ret AS xy FROM fi a CROSS JOIN ks LEFT JOIN fi b ON b.symbol = a.symbol AND b.i = a.i - k),
mom AS (SELECT gt.t, symbol, k, g, sum(y) AS s, sum(y * y) AS q, sum(y) FILTER (i < g - k) AS sx, sum(y * y) FILTER (i < g - k) AS qx, sum(y) FILTER (i >= k) AS sy, sum(y * y) FILTER (i >= k) AS qy, sum(xy) AS xy
 FROM lag_k JOIN gt ON lag_k.en <= gt.t WHERE g > 1 GROUP BY 1, 2, 3, 4),
rhos AS (SELECT t, symbol, sum((1 - k / 5.0) * CASE WHEN g > k AND qx - sx * sx / (g - k) > 1e-18 AND qy - sy * sy / (g - k) > 1e-18 THEN (xy - sx * sy / (g - k)) / sqrt((qx - sx * sx / (g - k)) * (qy - sy * sy / (g - k))) ELSE 0 END) AS rho
 FROM (SELECT t, symbol, k, g, s, q, coalesce(sx, 0) AS sx, coalesce(qx, 0) AS qx, coalesce(sy, 0) AS sy, coalesce(qy, 0) AS qy, xy FROM mom WHERE (q - s * s / g) / (g - 1) >= 1e-16) x GROUP BY 1, 2),
kap AS (SELECT s.t, CASE WHEN avg(rho) IS NULL THEN 45 ELSE least(75, greatest(30, 175 * (1 + 2 * avg(rho)))) END AS kappa FROM snaps s LEFT JOIN rhos USING (t) GROUP BY 1)"""
COV = f"""{SNAPS}, {ENTER}, {KAP},
gs AS (SELECT s.t, count(x.date) AS gs FROM snaps s LEFT JOIN (SELECT date, min(en) AS en FROM e GROUP BY 1) x ON x.en <= s.t GROUP BY 1),
ss AS (SELECT s.t, symbol, nav, sum(ret) AS s FROM e JOIN snaps s ON e.en <= s.t GROUP BY 1, 2, 3),
xy AS (SELECT a.symbol AS sym_i, b.symbol AS sym_j, CASE WHEN a.nav OR b.nav THEN a.ne ELSE a.en END AS p, sum(a.ret * b.ret) AS v FROM e a JOIN e b ON a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2, 3),
xc AS (SELECT sym_i, sym_j, p, sum(v) OVER (PARTITION BY sym_i, sym_j ORDER BY p) AS v FROM xy WHERE p IS NOT NULL),
pr AS (SELECT a.t, a.symbol AS sym_i, b.symbol AS sym_j, a.nav OR b.nav AS slow, a.s AS si, b.s AS sj FROM ss a JOIN ss b ON a.t = b.t AND a.symbol <= b.symbol),
cv AS (SELECT pr.t AS snapshot_time, pr.sym_i, pr.sym_j, CASE WHEN slow THEN 5 * (coalesce(v, 0) - si * sj / gs) / (gs - 1) ELSE kappa * (coalesce(v, 0) - si * sj / g) / (g - 1) END AS cov
 FROM (SELECT * FROM pr JOIN gt USING (t) JOIN gs USING (t) JOIN kap USING (t) WHERE CASE WHEN slow THEN gs > 1 ELSE g > 1 END) pr
 ASOF LEFT JOIN xc ON xc.sym_i = pr.sym_i AND xc.sym_j = pr.sym_j AND pr.t >= xc.p)"""
BOUND = f"""{COV}, mir AS (SELECT * FROM cv UNION ALL SELECT snapshot_time, sym_j, sym_i, cov FROM cv WHERE sym_i < sym_j),
gr AS (SELECT snapshot_time, sym_i, sum(CASE WHEN sym_i = sym_j THEN cov ELSE 0 END) AS d, sum(CASE WHEN sym_i <> sym_j THEN abs(cov) ELSE 0 END) AS r FROM mir GROUP BY 1, 2),
bd AS (SELECT snapshot_time, min(d - r) AS lower, max(d + r) AS upper FROM gr GROUP BY 1)"""
AUDIT = "au AS (SELECT s.t AS snapshot_time, count(*) AS checked, count(*) FILTER (date > CASE WHEN nav THEN s.c ELSE s.t END) AS filtered, count(*) FILTER (NOT nav AND date > s.t) AS intraday_violations, count(*) FILTER (nav AND date > s.c) AS nav_violations FROM snaps s, lr GROUP BY 1)"

add("p02_many_snapshots", lambda v: snapshots.audit(v("daily_bars"), fridays(v)), "daily_bars", f"WITH {SNAPS}, {AUDIT} SELECT * FROM au", "snapshot_time checked filtered intraday_violations nav_violations")
add("r12_many_snapshots", lambda v: snapshots.snapshot_volatility(v("daily_bars"), fridays(v)), "daily_bars", f"WITH {STATE} SELECT * FROM st", "snapshot_time symbol asset_type is_fallback", "vol", 5)
add("r14_many_snapshots", lambda v: snapshots.bitemporal_cov(v("daily_bars"), fridays(v)), "daily_bars", f"WITH {COV} SELECT * FROM cv", "snapshot_time sym_i sym_j", "cov", 4)
add("r17_r18_many_snapshots", lambda v: snapshots.cov_bounds(v("daily_bars"), fridays(v)), "daily_bars", f"WITH {BOUND} SELECT snapshot_time, kappa, lower, upper, CASE WHEN lower > 0 THEN upper / lower END AS condition_bound, lower > 0 AS surely_definite, {EPS} AS eps FROM bd JOIN kap ON t = snapshot_time", "snapshot_time surely_definite", "kappa lower upper condition_bound eps", 3)
add("r24_many_snapshots", lambda v: snapshots.risk_report(v("daily_bars"), fridays(v)), "daily_bars", f"WITH {BOUND}, {AUDIT}, {STATE.removeprefix(SNAPS + ', ')} SELECT st.*, kappa, d + {EPS} AS variance, checked, filtered, intraday_violations, nav_violations FROM st JOIN kap ON t = snapshot_time JOIN au USING (snapshot_time) LEFT JOIN bd USING (snapshot_time) LEFT JOIN gr ON gr.snapshot_time = st.snapshot_time AND gr.sym_i = st.symbol", "snapshot_time symbol asset_type days_used is_floored is_fallback checked filtered intraday_violations nav_violations", {"auction_ratio": 6, "vol": 5, "kappa": 3, "variance": 3})
