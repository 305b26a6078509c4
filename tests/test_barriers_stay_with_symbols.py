"""Cards and bars meet where they were dealt by symbol."""

import datetime as dt
import random

import __spark_entry__ as entry
from tidepanel.operators import labels

SMALL = "/root/testdata/sf0.001"
D = dt.date(2020, 1, 1)


def test_nothing_but_bars_and_cards_is_shuffled(spark):
    plan = entry.queries()["l03_path_barrier_outcome"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange " in line and "SinglePartition" not in line]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in line for line in dealt)
    assert "Join" not in plan


def test_every_length_and_alignment_and_odd_rows(spark):
    rng = random.Random(8)
    bars = [(s, D + dt.timedelta(days=t), 10 + rng.random(), 9 + rng.random()) for s in (1, 2) for t in range(70) if rng.random() < 0.5]
    odd = [(None, D, 99.0, 0.1), (1, None, 99.0, 0.1)]
    cards = [(70 * a + n, 1 + n % 2, D + dt.timedelta(days=a), D + dt.timedelta(days=a + n)) for a in range(35) for n in range(35)]
    odd_cards = [(-1, None, D, D), (-2, 1, None, D), (-3, 1, D, None), (-4, 1, D, D - dt.timedelta(days=1)), (-5, 7, D, D)]
    given = spark.createDataFrame([(*c, 10.9, 9.05) for c in cards + odd_cards], "card_id long, symbol long, issue_date date, due_date date, target double, stop double")
    out = labels.path_barrier_outcome(given, spark.createDataFrame(bars + odd, "symbol long, date date, high double, low double")).collect()
    assert len(out) == len(cards) + len(odd_cards)
    got = {r.card_id: (r.max_price, r.min_price) for r in out}
    for k, s, a, b in cards:
        own = [r for r in bars if r[0] == s and a <= r[1] <= b]
        assert got[k] == (max((r[2] for r in own), default=None), min((r[3] for r in own), default=None))
    assert all(got[c[0]] == (None, None) for c in odd_cards)
