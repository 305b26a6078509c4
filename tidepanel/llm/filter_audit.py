"""Interaction audit of five document filters: what each removes in every order, and its exact share over all orders.

Which filters a document fails is a mask of five bits, so a part (a language) is described by at most 32 masks, each with
its documents, good ones and toxic ones. From these the removals of all 32 coalitions of filters are tabulated; a filter
that follows a coalition removes the difference of two of them. Shares (Shapley values) are the exact solution, in
rationals, of the kernel-weighted least-squares fit of an additive game whose sum is that of all five filters.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Rows of a part: what a table of one mask holds.
KINDS = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, sha binary, mask int): the bits of the filters A to D that each text fails; null texts are empty."""
    x = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("words", F.array_remove(F.split("text", r"[ \t-\r]+"), ""))
    n, points = F.size("words").cast("long"), F.length("text").cast("long")
    capitals = points - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [n < LEAST_WORDS, 100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * points, F.col("text").rlike(SYMBOLS)]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return x.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask int, n, good, toxic): documents of each part by the set of filters that they fail.

    Texts travel as their SHA-256. Documents are counted by (text, part, doc_id), then by (text, part) with the smallest
    doc_id kept apart, then by part and mask: each step combines before it shuffles, so a text that a third of all rows
    share is one entry per task. Equal texts have equal bits A to D; E is missing only from the rows of the smallest doc_id
    of their text and from rows without doc_id, which are earlier than nothing and later than nothing.

    A doc_id counts as good (toxic) if any of its label rows says so; rows that share it all do.
    """
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = marked.where("good = 1 or toxic = 1").withColumnRenamed("doc_id", "marked_id")
    rows = text_masks(docs)
    ids = rows.groupBy("sha", "part", "doc_id", "mask").agg(F.count("*").alias("n"))
    ids = ids.join(marked, F.col("doc_id") == F.col("marked_id"), "left").select("sha", "part", "doc_id", "mask", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in KINDS[1:]])
    known = F.col("doc_id").isNotNull()
    least = F.min(F.when(known, F.struct("doc_id", *KINDS)))
    texts = ids.groupBy("sha", "part", "mask").agg(least.alias("least"), *[F.sum(c).alias(c) for c in KINDS], *[F.sum(F.when(~known, F.col(c)).otherwise(0)).alias(f"no_id_{c}") for c in KINDS])
    # a text has one row a part here, so the window sees as many rows as there are parts
    texts = texts.withColumn("earliest", F.min("least.doc_id").over(Window.partitionBy("sha")))
    first = F.when(F.col("least.doc_id") == F.col("earliest"), 1).otherwise(0)
    free = [(F.coalesce(first * F.col(f"least.{c}"), F.lit(0)) + F.col(f"no_id_{c}")).alias(c) for c in KINDS]
    split = texts.select("part", F.explode(F.array(F.struct("mask", *free), F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - f).alias(c) for c, f in zip(KINDS, free, strict=True)]))).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(*[F.sum(f"x.{c}").alias(c) for c in KINDS])


def solved(a: list[list[Fraction]], b: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of a X = b by Gauss-Jordan elimination in rationals."""
    n = len(a)
    rows = [list(x) + list(y) for x, y in zip(a, b, strict=True)]
    for k in range(n):
        p = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[p] = rows[p], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [r[n:] for r in rows]


class AdditiveFit:
    """Kernel-weighted least squares of a game on n players under the constraint that shares add up to the whole.

    A coalition of s players weighs (n - 1) / (C(n, s) s (n - s)); the empty and the full one are the constraint. The
    normal equations, with a multiplier for the constraint, do not depend on the game: they are solved once for every
    coalition's value, so that shares are a rational combination of these values.
    """

    def __init__(self, n: int):
        self.n, whole = n, (1 << n) - 1
        inner = [s for s in range(1, whole)]
        weight = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in inner}
        bit = lambda s, i: s >> i & 1
        normal = [[sum((weight[s] for s in inner if bit(s, i) and bit(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
        normal.append([Fraction(1)] * n + [Fraction(0)])
        right = [[weight[s] * bit(s, i) if 0 < s < whole else Fraction(0) for s in range(whole + 1)] for i in range(n)]
        right.append([Fraction(int(s == whole)) for s in range(whole + 1)])
        self.rows = solved(normal, right)[:n]

    def shares(self, value: list[int]) -> list[Fraction]:
        """Shares of a game given by the value of each coalition, that of the empty one being 0."""
        return [sum((c * v for c, v in zip(row, value, strict=True)), Fraction(0)) for row in self.rows]


def coalition_removals(by_mask: list[int]) -> list[int]:
    """Documents that at least one filter of each coalition removes, from the number of documents of each mask."""
    inside = list(by_mask)
    for k in range(len(FILTERS)):
        for s in range(FULL + 1):
            if s >> k & 1:
                inside[s] += inside[s ^ 1 << k]
    # inside[s]: documents whose failures all lie in s; a coalition leaves those that fail nothing but others
    return [inside[FULL] - inside[FULL ^ s] for s in range(FULL + 1)]


def part_rows(part: str, tables: dict[str, list[int]], fit: AdditiveFit) -> list[tuple]:
    """All orders and steps of one part; tables has 32 counts for each of KINDS."""
    gone = {kind: coalition_removals(t) for kind, t in tables.items()}
    total = sum(tables["n"])
    orders = len(ORDERS)
    shares = [x * orders for x in fit.shares(gone["n"])]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("removals over all orders are whole numbers")
    out = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            k = FILTERS.index(name)
            after = before | 1 << k
            removed = {kind: g[after] - g[before] for kind, g in gone.items()}
            out.append((part, order, step, total - gone["n"][after], removed["n"], gone["n"][1 << k] - removed["n"], tables["n"][1 << k], removed["good"], removed["toxic"], int(shares[k])))
            before = after
    return out


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step for docs (doc_id, text, lang) and labels (doc_id, quality, toxic).

    Parts are the values of lang, null being the empty string; each has all 120 orders and five steps, zeros included.
    Filters fail texts of under 200 words (A), of which under half are distinct (B), with over 3 % of A-Z (C), with any
    of # $ % & * | (D), and texts that a smaller doc_id has, too (E). Null texts are empty ones. Repeated rows count one by
    one and are no copies of each other; rows without doc_id fail no E and have no labels. Other columns are ignored. An
    empty table has no parts.

    removed: here; redundant: fails the filter but is removed earlier; unique_fails: fails no other filter; good_lost and
    toxic_lost: labelled so and removed here; shapley: removed by the filter, summed over all orders.
    """
    table = lambda kind: F.map_from_entries(F.collect_list(F.struct("mask", kind))).alias(kind)
    parts = mask_counts(docs, labels).groupBy("part").agg(*[table(k) for k in KINDS])  # at most 32 entries each

    def run(batches):
        fit = AdditiveFit(len(FILTERS))
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
        names = ["part", "filter_order", "step", *COUNTS]
        for batch in batches:
            for row in batch.to_pylist():
                tables = {k: [dict(row[k]).get(m, 0) for m in range(FULL + 1)] for k in KINDS}
                columns = zip(*part_rows(row["part"], tables, fit), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return parts.mapInArrow(run, RESULT)
