"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 10 consecutive benchmark words (shorter items are one window). For the patterns of one length m
a shift table is indexed by the hash of a block of words: a block that ends no pattern prefix lets the search jump. Where
the shift is zero, the hash of the last block picks a bucket of patterns, and the words are compared one by one. Many
pieces of text are searched in step with numpy, each with a position of its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import cut, fields_but, free_name, schema_of, small_batches
from tidepanel.llm.words import ALNUM, Words, grams_at

WINDOW = 10
BLOCK = 3
#: Text bytes of benchmark items that one broadcast table may hold; more items are searched in further passes.
TABLE_BYTES = 8 << 20
PIECE_WORDS = 512


class Patterns:
    """Shift table and suffix buckets for the patterns of one length m, which are places in the words of all items.

    Flat arrays only: about 6 bytes for each byte of benchmark text, and at most 16 MB (32 MB from windows of 257 words on)
    for the shifts.
    """

    def __init__(self, m: int, words: Words, at: np.ndarray, owner: np.ndarray, items: list[list[str]]):
        self.m, self.b = m, min(BLOCK, m)
        self.at, self.owner, self.items = at, owner, items
        self.data, self.start, self.end = words.data, words.start.astype(np.int32), words.end.astype(np.int32)
        jump = m - self.b + 1
        self.bits = max(12, min(24, math.ceil(math.log2(8 * jump * len(at) + 1))))
        self.shift = np.full(1 << self.bits, min(jump, 65535), dtype=np.uint8 if jump < 256 else np.uint16)
        for end in range(self.b, m + 1):
            np.minimum.at(self.shift, self.slot(grams_at(words.hash, at + end - self.b, self.b)), min(m - end, 65535))
        suffix = grams_at(words.hash, at + m - self.b, self.b)
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.suffix = suffix[self.order]

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words, left: np.ndarray):
        """(position, pattern) of every occurrence in words; blocks that are skipped are not looked at."""
        total, m = len(words.hash), self.m
        if total < m:
            return [], []
        at = np.arange(m - 1, total, PIECE_WORDS)  # last word of the window tried
        stop = np.minimum(at + PIECE_WORDS, total)
        found = []
        while len(at):
            step = self.shift[self.slot(grams_at(words.hash, at - self.b + 1, self.b))]
            if (zero := step == 0).any():
                found.append(at[zero])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return [], []
        ends = np.sort(np.concatenate(found))
        starts = ends - m + 1
        ends, starts = ends[left[starts] >= m], starts[left[starts] >= m]
        keys = grams_at(words.hash, ends - self.b + 1, self.b)
        lo, hi = np.searchsorted(self.suffix, keys, "left"), np.searchsorted(self.suffix, keys, "right")
        spots, which = [], []
        for s, a, b in zip(starts[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            text = [words.word(k) for k in range(s, s + m)]
            for p in self.order[a:b].tolist():
                q = int(self.at[p])
                if all(self.data[self.start[q + k] : self.end[q + k]] == text[k] for k in range(m)):
                    spots.append(s)
                    which.append(p)
        return spots, which


def compile_patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Pattern tables by length, from (item id, text); items without words have none, those with one text share theirs."""
    by: dict[str, list[str]] = {}
    for item, text in items:
        if text:
            by.setdefault(text, []).append(item)
    words = Words(list(by), ALNUM, lower=True)
    count, names = np.diff(words.first), list(by.values())
    length = np.minimum(count, window)
    out = []
    for m in np.unique(length[length > 0]).tolist():
        some = np.flatnonzero(length == m)
        places = count[some] - m + 1
        at = np.repeat(words.first[some] - (np.cumsum(places) - places), places) + np.arange(int(places.sum()))
        out.append(Patterns(m, words, at, np.repeat(some, places).astype(np.int32), names))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """All columns of docs and n_words long, n_hit long, n_items long, items array<string>, items_sha256 string,
    contaminated boolean; columns of docs with these names are replaced.

    docs holds text, benchmark item_id and text. Words are lower-cased (A-Z) runs of digits, letters and non-ASCII bytes.
    Null or wordless texts and items match nothing. Items with equal text all count; repeated rows of an item count once.
    The items are broadcast in groups of at most table_bytes of text each, one pass over docs a group; with one group
    (the usual case, checked) nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(1.25 * size / table_bytes))
    if groups > 1:
        items = cut(items)
    made = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
    fields = fields_but(docs, made)
    names = [f.name for f in fields]
    base = docs.select(*[F.col(f"`{n}`") for n in names])
    spans = "array<struct<start:int,end:int>>"
    row = free_name(base, "row")
    if groups > 1:
        base = cut(base.withColumn(row, F.monotonically_increasing_id()))
    parts = []
    for g in range(groups):
        mine = items if groups == 1 else items.where(F.pmod(F.hash("item_id"), F.lit(groups)) == g)
        tables = spark.sparkContext.broadcast(compile_patterns([(r.item_id, r.text) for r in mine.sort("item_id", "text").collect()], window))
        if groups == 1:
            parts.append(base.mapInArrow(_searcher(tables, names, False), schema_of(fields, "n_words long", "n_hit long", "n_items long", "items array<string>", "items_sha256 string", "contaminated boolean")))
        else:
            parts.append(base.select(row, "text").mapInArrow(_searcher(tables, [row], True), f"{row} long, n_words long, spans {spans}, items array<string>"))
    if groups == 1:
        return parts[0]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy(row).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # sweep over the sorted spans: (words hit, end of the last span)
    hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(a.to, s.start))).alias("n"), F.greatest(a.to, s.end).alias("to")), lambda a: a.n.cast("long"))
    found = found.select(row, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return base.join(found, row).drop(row).withColumn("contaminated", F.col("n_hit") > 0)


def _searcher(tables, names: list[str], raw: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            words = Words(texts, ALNUM, lower=True)
            left, n = words.left(), len(texts)
            marks = np.zeros(len(words.hash) + 1, dtype=np.int64)
            items: dict[int, set] = {}
            for p in tables.value:
                spots, which = p.search(words, left)
                if spots:
                    s = np.array(spots)
                    np.add.at(marks, s, 1)
                    np.add.at(marks, s + p.m, -1)
                    for d, k in zip((np.searchsorted(words.first, s, "right") - 1).tolist(), which, strict=True):
                        items.setdefault(d, set()).update(p.items[p.owner[k]])
            hit = np.cumsum(marks[:-1]) > 0
            own = [sorted(items.get(d, ())) for d in range(n)]
            count = pa.array(np.diff(words.first), pa.int64())
            keep = [batch.column(batch.schema.get_field_index(x)) for x in names]
            if raw:
                spans = []
                for d in range(n):
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[words.first[d] : words.first[d + 1]].astype(np.int8), [0]))))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([*keep, count, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(own, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])
                continue
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[words.first[1:]] - total[words.first[:-1]]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in own]
            yield pa.RecordBatch.from_arrays([*keep, count, pa.array(n_hit, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.string())), pa.array(sha, pa.string()), pa.array(n_hit > 0, pa.bool_())], [*names, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return run
