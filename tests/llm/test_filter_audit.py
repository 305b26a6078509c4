"""Filter audit: every order by brute force, exact shares, odd input."""

import random
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest

from tidepanel.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, mask string"


def fails(docs):
    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    out = []
    for k, t, _ in docs:
        t = t or ""
        w = [x for x in t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        capitals = sum("A" <= c <= "Z" for c in t)
        out.append((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * capitals > 3 * len(t), any(c in "#$%&*|" for c in t), k is not None and first[t] < k))
    return out


def brute(docs, labels):
    flags, rows = fails(docs), {}
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    for part in {lang or "" for _, _, lang in docs}:
        own = [(k, f) for (k, _, lang), f in zip(docs, flags, strict=True) if (lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, name in enumerate(order, 1):
                c = "ABCDE".index(name)
                gone, alive_next = [x for x in alive if x[1][c]], [x for x in alive if not x[1][c]]
                failing = sum(f[c] for _, f in own)
                only = sum(f[c] and sum(f) == 1 for _, f in own)
                rows[part, order, step] = [len(alive_next), len(gone), failing - len(gone), only, sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
                alive = alive_next
    total = {}
    for (part, order, step), r in rows.items():
        key = part, order[step - 1]
        total[key] = total.get(key, 0) + r[1]
    return {(*k, *r, total[k[0], k[1][k[2] - 1]]) for k, r in rows.items()}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)] + ["ABC", "Upper", "a#b", "$", "é", "x|y"]
    text = lambda n, v: "".join(rng.choice(v) + rng.choice([" ", "  ", "\n", "\x0b"]) for _ in range(n))
    out = [(k, text(rng.choice([3, 150, 220, 400]), words if k % 3 else words[:60]), rng.choice(["en", "de", None, ""])) for k in range(120)]
    out += [(200 + k, out[k % 7][1], "en") for k in range(40)] + [(300, None, "en"), (301, "", "de"), (None, "", "de"), (None, out[3][1], "en"), (302, " \t", None), (5, out[5][1], out[5][2]), (3, "x " * 100_000, "fr")]
    rng.shuffle(out)
    return out


def test_audit_equals_brute_force(spark, docs):
    rng = random.Random(12)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k, _, _ in docs if rng.random() < 0.7] + [(None, 1, 1), (9999, 1, 1), (200, 1, 0), (200, 0, 1)]
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA).repartition(3)
    got = filter_audit.audit_filters(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * len({lang or "" for _, _, lang in docs})
    assert {tuple(r) for r in got} == brute(docs, labels)


def test_shares_are_exact():
    rng = random.Random(3)
    for n in (2, 3, 5):
        value = [0, *[rng.randrange(1000) for _ in range((1 << n) - 1)]]
        want = [sum(Fraction(factorial(s.bit_count()) * factorial(n - s.bit_count() - 1), factorial(n)) * (value[s | 1 << i] - value[s]) for s in range(1 << n) if not s >> i & 1) for i in range(n)]
        assert filter_audit.AdditiveFit(n).shares(value) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(spark.createDataFrame([], SCHEMA), none).count() == 0
    one = filter_audit.audit_filters(spark.createDataFrame([(1, None, None, "", "")], SCHEMA), none)
    assert one.where("step = 1 and substr(filter_order, 1, 1) = 'A'").select("kept", "removed", "unique_fails", "shapley").distinct().collect() == [(0, 1, 1, 120)]
