"""Values of the operators that no SQL states: draws by hash, noise, forests, their calibration, and panel sums."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import evaluation, labels, ml, risk, technical

D = dt.date(2026, 1, 1)


def test_blended_sample_is_the_draw(spark):
    rows = [(s, D + dt.timedelta(days=30 * k)) for k in range(130) for s in range(1 + k % 3)]
    df = spark.createDataFrame(rows, "symbol long, date date")
    draw = {r.date: r.h for r in df.select("date", F.xxhash64("date", F.lit(7)).alias("h")).distinct().collect()}
    dates = sorted(draw)
    past = sorted(dates[-105:-1], key=lambda d: (draw[d], d))[:4]
    got = sorted((r.symbol, r.date, r.is_new) for r in labels.blended_sample(df).collect())
    assert got == sorted((s, d, d == dates[-1]) for s, d in rows if d == dates[-1] or d in past)


def test_noise_sensitivity_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(D + dt.timedelta(days=d), s, float(rng.normal()), float(rng.normal())) for d in range(6) for s in range(25)]
    df = spark.createDataFrame(rows, "date date, symbol long, score double, actual double")
    share = lambda a, b, seed: ((F.pmod(F.xxhash64(a, b, F.lit(seed)), F.lit(1 << 20)) + 1) / float((1 << 20) + 1))
    x = df.withColumn("u", share("date", "symbol", 11)).withColumn("v", share("symbol", "date", 12)).toPandas()
    x["noisy"] = x.score + 0.5 * x.groupby("date").score.transform(lambda c: c.std(ddof=0)) * np.sqrt(-2 * np.log(x.u)) * np.cos(2 * np.pi * x.v)

    def ndcg(day, score):
        gain = 2 ** np.maximum(day.actual.to_numpy(), 0) - 1
        top = lambda by: sum(gain[i] / math.log2(p + 2) for p, i in enumerate(np.argsort(-day[by].to_numpy(), kind="stable")[:10]))
        return top(score) / top("actual")

    clean, noisy = (np.mean([ndcg(day, c) for _, day in x.groupby("date")]) for c in ("score", "noisy"))
    got = evaluation.noise_sensitivity(df).first()
    assert math.isclose(got.clean, clean, rel_tol=1e-9) and math.isclose(got.noisy, noisy, rel_tol=1e-9) and math.isclose(got["drop"], clean - noisy, abs_tol=1e-9)


@pytest.fixture(scope="module")
def learned(spark):
    """The label follows a_ranked, but is drawn at random where b_ranked is above 0.7."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        a, b = map(float, rng.random(2))
        label = int(rng.integers(-1, 2)) if b > 0.7 else int(a > 2 / 3) - int(a < 1 / 3)
        rows.append((k % 30, D + dt.timedelta(days=k // 30), label, 1.0, a, None if b < 0.05 else b))
    df = spark.createDataFrame(rows, "symbol long, date date, label int, weight double, a_ranked double, b_ranked double").cache()
    direction = ml.train_direction(df)
    return df, direction, ml.train_meta(df, direction)


def test_forests_learn_and_score(learned):
    df, direction, meta = learned
    got = ml.score_panel(df, direction, meta).collect()
    assert len(got) == 900
    sure = [r for r in got if r.b_ranked <= 0.7]
    doubtful = [r for r in got if r.b_ranked > 0.7]
    assert np.mean([r.predicted == r.label for r in sure]) > 0.9
    assert np.mean([r.p_raw for r in sure]) > np.mean([r.p_raw for r in doubtful]) + 0.1
    for r in got:
        p = (r.p_bear, r.p_neutral, r.p_bull)
        assert math.isclose(sum(p), 1, rel_tol=1e-9) and p[r.predicted + 1] == max(p)
        assert math.isclose(r.p_success, min(max(0.15 + (r.p_raw - 0.28) / (0.81 - 0.28 + 1e-5) * 0.70, 0), 1), abs_tol=1e-12)


def test_gaps_score_like_the_middle(learned, spark):
    df, direction, meta = learned
    two = spark.createDataFrame([(1, 0.2, None), (2, 0.2, 0.5)], "symbol long, a_ranked double, b_ranked double")
    a, b = ml.score_panel(two, direction, meta).collect()
    assert (a.p_bear, a.p_bull, a.p_raw) == (b.p_bear, b.p_bull, b.p_raw)


def test_kept_model_is_the_first_of_the_best(learned):
    df, direction, _ = learned
    weak = ml.train_direction(df.withColumn("label", F.lit(0)), trees=2, depth=1)
    got = {r.model: r for r in ml.champion_challenger(df, {"z": direction, "b": direction, "a": weak}).collect()}
    assert math.isclose(got["a"].accuracy, df.where("label = 0").count() / 900) and got["b"].accuracy == got["z"].accuracy > 0.6
    assert {k: r.kept for k, r in got.items()} == {"a": False, "b": True, "z": False}


def test_calibration_is_the_logistic_fit(spark):
    """At the best curve residuals have no mean and do not go along with the score."""
    rng = np.random.default_rng(8)
    rows = [(float(s), float(rng.random() < 1 / (1 + math.exp(2 - 4 * s)))) for s in rng.random(800)]
    df = spark.createDataFrame(rows, "s double, y double")
    got = ml.calibrate(df, "s", "y").transform(df).withColumn("p", ml.vector_to_array("calibrated_p")[1]).collect()
    rest = np.array([r.p - r.y for r in got])
    assert abs(rest.mean()) < 1e-4 and abs((rest * [r.s for r in got]).mean()) < 1e-4


def test_newey_west_equals_the_dense_one(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5)) * (rng.random((40, 5)) < 0.6)
    x[:, 4] = 0
    df = spark.createDataFrame([(s, t, float(x[t, s])) for t in range(40) for s in range(4) if x[t, s]] + [(4, 3, 0.0)], "symbol int, ts int, ret double")
    g = x[[t for t in range(40) if x[t].any() or t == 3]]
    rho = [sum((1 - k / 5) * np.corrcoef(g[:-k, s], g[k:, s])[0, 1] for k in range(1, 5)) for s in range(4)]
    got = risk.newey_west_kappa(df).first()
    assert math.isclose(got.avg_rho, np.mean(rho), rel_tol=1e-9)
    assert math.isclose(got.kappa, min(max(175 * (1 + 2 * np.mean(rho)), 30), 75), rel_tol=1e-9)


def test_repeated_spans_stay(spark):
    rows = [(1, 1, 4, 0.03), (1, 1, 4, 0.03), (1, 9, 9, None)]
    got = sorted((r.start_t, r.uniqueness) for r in labels.label_uniqueness(spark.createDataFrame(rows, "symbol long, start_t int, end_t int, ret double")).collect())
    assert got == [(1, 0.5), (1, 0.5), (9, 1.0)]


def test_oscillator_equals_the_recursion(spark):
    rng = np.random.default_rng(2)
    close = 10 + np.cumsum(rng.normal(size=60))
    df = spark.createDataFrame([(1, D + dt.timedelta(days=k), float(c)) for k, c in enumerate(close)], "symbol long, date date, close double")

    def mean(x, n):
        out = [x[0]]
        for v in x[1:]:
            out.append(out[-1] + 2 / (n + 1) * (v - out[-1]))
        return np.array(out)

    ppo = (mean(close, 12) - mean(close, 26)) / np.maximum(0.001, mean(close, 26)) * 100
    signal = mean(ppo, 9)
    got = technical.ppo_macd(df).orderBy("date").collect()
    assert np.allclose([r.ppo for r in got], ppo) and np.allclose([r.signal for r in got], signal)
    assert np.allclose([r.delta for r in got][1:], np.diff(ppo - signal)) and got[0].delta is None
