"""Tiles of many snapshots (F9, F12, F15): few of them, of one side each, and blocks inside them equal plain sums."""

import math

import numpy as np
import pyarrow as pa

from tidepanel.functions import tiles
from tidepanel.operators import snapshots

D, S = 12, 5
FAST, SLOW = np.minimum(np.arange(D) // 2, S), np.minimum((np.arange(D) + 1) // 2, S)


def test_tiles_are_few_and_of_one_side(spark):
    x = spark.range(5000).selectExpr("id as symbol", "cast(id % 3 = 0 as int) as side")
    names = tiles.fitted(x, spark.createDataFrame([(80,)], "g long"), "side").join(x, "symbol")
    assert names.agg({"n_tiles": "max"}).first()[0] <= tiles.TILES + 2
    assert names.groupBy("tile").agg({"side": "sum", "*": "count"}).where("`sum(side)` not in (0, `count(1)`)").count() == 0


def side(x, nav, tile):
    cells = [[{"idx": t, "ret": float(r[t])} for t in range(D) if r[t] != 0] for r in x]
    days = [{"idx": t, "enter": int(FAST[t]), "nav_enter": int(SLOW[t])} for t in range(D)]
    facts = [{"s": s, "n_fast": int((FAST <= s).sum()), "n_slow": int((np.minimum(FAST, SLOW) <= s).sum()), "kappa": 40.0 + s} for s in range(S)]
    n = len(x)
    rows = {"tile": pa.array([tile] * n, pa.int32()), "pos": pa.array(range(n), pa.int32()), "symbol": pa.array([100 * tile + k for k in range(n)]), "cells": pa.array(cells), "nav": pa.array([nav] * n), "days": pa.array([days] + [None] * (n - 1)), "facts": pa.array([facts] + [None] * (n - 1))}
    return tiles.Side([pa.RecordBatch.from_pydict(rows)])


def plain(x, y, nav):
    """{(s, i, j): cov} of what each snapshot sees; pairs with a return that is not finite are left out."""
    out, n = {}, {}
    for s in range(S):
        size = (np.minimum(FAST, SLOW) if any(nav) else FAST) <= s
        pairs = (SLOW if any(nav) else FAST) <= s
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                u, v = (np.where((SLOW if k else FAST) <= s, r, 0.0) for k, r in zip(nav, (a, b), strict=True))
                n = size.sum()
                if n < 2 or not u.any() or not v.any():
                    continue
                with np.errstate(invalid="ignore"):
                    cov = ((a * b)[pairs].sum() - u.sum() * v.sum() / n) / (n - 1) * (5.0 if any(nav) else 40.0 + s)
                if math.isfinite(cov):
                    out[s, i, j] = cov
    return out


def test_blocks_equal_plain_sums(monkeypatch):
    monkeypatch.setattr(snapshots, "WIDTH", 3)
    monkeypatch.setattr(tiles, "CELLS", 8 * S * 4)
    rng = np.random.default_rng(2)
    x, y = (rng.normal(0, 1, (n, D)) * (rng.random((n, D)) < 0.6) for n in (7, 8))
    x[2, 7] = np.inf
    x[4, :9] = 0.0
    for nav in ((False, False), (False, True), (True, True)):
        for same in (False, True):
            if same and nav[0] != nav[1]:
                continue
            a = side(x, nav[0], 0)
            b = a if same else side(y, nav[1], 1)
            want = plain(x, x if same else y, nav)
            pair = snapshots._Pair(a, b, same)
            got = {}
            for batch in snapshots._pair_rows(pair):
                for r in batch.to_pylist():
                    got |= {(r["s"] + k, r["sym_i"] % 100, r["sym_j"] % 100): c for k, c in enumerate(r["covs"])}
            kept = {k: v for k, v in want.items() if not same or k[1] <= k[2]}
            assert got.keys() == kept.keys() and all(abs(v - kept[k]) < 1e-9 for k, v in got.items())
            for number, batch in enumerate(snapshots._row_sums(pair)):
                for r in batch.to_pylist():
                    for s in range(S):
                        own = {k: v for k, v in want.items() if k[0] == s and k[1 + number] == r["pos"]}
                        assert math.isnan(r["r"][s]) == (not own)
                        if own:
                            d = sum(v for k, v in own.items() if same and k[1] == k[2])
                            assert abs(r["r"][s] - (sum(map(abs, own.values())) - abs(d))) < 1e-9 and (not same or abs(r["d"][s] - d) < 1e-9)
