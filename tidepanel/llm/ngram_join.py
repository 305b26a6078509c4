"""Similarity join of documents on word shingles by vertical partitioning of the global shingle order.

A document is its set of 4-word shingles (64-bit hashes). The global order puts rare shingles first, by the counts of a
table of fixed size over the whole corpus, ties by hash. Two sets with Jaccard similarity t share a shingle in the first
(1 - t) of each, so only those prefixes travel to propose pairs; identical sets are one vertex from the start. Pairs whose
sketches (parities of the hashes, about a bit a shingle) differ in more bits than linked sets can differ in shingles are
given up before any text travels. The sets in some pair that is left are cut into fragments of the global order, which
lie in rows and tasks of their own: the overlap of a pair is counted in each fragment separately and summed per pair. The
rarest fragment goes first, and pairs that cannot reach the threshold any more are given up before the others travel.

There are three rounds. The first takes one pair for each set, that of the likest other one, and the second what is left of the
pairs between different components. Long posting lists propose stars only; the third round compares those of their members
that are still in different components, so that nothing is lost and a group of near copies never becomes all its pairs.
Lists are split into salted pieces, so no task holds a whole long one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.components import components
from tidepanel.llm.exchange import bucket_bounds
from tidepanel.llm.store import cut, small_batches, tidy
from tidepanel.llm.words import SPACED, Words, grams, mix

SHINGLE = 4
PERCENT = 85
#: Cells of the count table that defines the global order; its size does not depend on the corpus.
CELLS = 1 << 23
CHUNKS = 32
#: Fragments of the global order, with about equally many shingle occurrences each.
FRAGMENTS = 4
#: Bits of the filter that keeps texts which are surely not wanted out of a shuffle; it may be full, but never drops any.
FILTER_BITS = 1 << 25
#: Bits of the largest sketch; sets of many more shingles are hardly told apart by it, and counted.
SKETCH_BITS = 1 << 13
#: Posting lists up to this length propose all their pairs at once.
SHORT_LIST = 8
#: Members that a piece of a long list has on average at most, and a block of the second round.
PIECE, BLOCK = 1 << 16, 2048
PREFIX_BUCKET_BYTES = 8 << 20


def shingle_sets(texts: list, n: int = SHINGLE):
    """(text index, shingle hash) of the distinct shingles, sorted by text and hash; a text of fewer words is one shingle."""
    words = Words(texts, SPACED, lower=True)
    doc, left = words.doc(), words.left()
    at = np.flatnonzero(left >= n)
    d, h = [doc[at]], [grams(words.hash, n)[at]]
    count = np.diff(words.first)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            d.append(short)
            h.append(grams(words.hash, k)[words.first[short]])
    d, h = np.concatenate(d), np.concatenate(h)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    fresh = np.ones(len(d), dtype=bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[fresh], h[fresh]


def set_ids(d: np.ndarray, h: np.ndarray, n: int):
    """Size and 63-bit identity of each text's set; an empty set has identity -1."""
    size = np.bincount(d, minlength=n)
    total = np.zeros(n, dtype=np.uint64)
    np.add.at(total, d, mix(h))
    ids = (mix(total + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return size, np.where(size > 0, ids, -1)


def sketches(d: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.Array:
    """Each text's sketch: the parity of the number of its shingles at each of 2^k bits, at least as many as shingles (64 to
    SKETCH_BITS). Every shingle that one of two sets has alone changes one bit. Empty sets have an empty sketch."""
    bits = np.where(size > 0, np.clip(2 ** np.ceil(np.log2(np.maximum(size, 1))), 64, SKETCH_BITS), 0).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(bits)))
    odd = np.zeros(start[-1], dtype=np.uint8)
    np.add.at(odd, start[d] + (mix(h) & (bits[d] - 1).astype(np.uint64)).astype(np.int64), 1)
    packed = np.packbits(odd & 1, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(packed)])


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the length of the other."""
    if len(x) < len(y):
        x, y = y, x
    a, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _counts(docs: DataFrame, shingle: int) -> tuple[DataFrame, bytes]:
    """(doc_id, set_id, n, sketch) of every row, and the level of each cell of the count table (8 MB)."""
    names = ["doc_id", "set_id", "n", "sketch", "chunk", "cells"]

    def run(batches):
        cells = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            d, h = shingle_sets(batch.column(1).to_pylist(), shingle)
            size, ids = set_ids(d, h, batch.num_rows)
            np.add.at(cells, (h & np.uint64(CELLS - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(size, pa.int64()), sketches(d, h, size), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
        step = CELLS // CHUNKS
        rows = [(k, zlib.compress(cells[k * step : (k + 1) * step].tobytes(), 1)) for k in range(CHUNKS) if cells[k * step : (k + 1) * step].any()]
        if rows:
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(rows), pa.binary()), pa.array([k for k, _ in rows], pa.int32()), pa.array([z for _, z in rows], pa.binary())], names)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(z), dtype=np.uint32).astype(np.uint64)
                sums[k] = sums[k] + own if k in sums else own
        for k, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(255, 4 * np.log2(own + 1.0)).astype(np.uint8).tobytes()], pa.binary())], ["chunk", "cells"])

    out = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, set_id long, n long, sketch binary, chunk int, cells binary"))
    chunks = out.where("chunk is not null").select("chunk", "cells").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, cells binary").collect()
    step = CELLS // CHUNKS
    level = np.zeros(CELLS, dtype=np.uint8)
    for r in chunks:
        level[r.chunk * step : (r.chunk + 1) * step] = np.frombuffer(bytes(r.cells), dtype=np.uint8)
    return out.where("chunk is null").select("doc_id", "set_id", "n", "sketch"), level.tobytes()


def _ranks(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places of shingles in the global order."""
    return (level[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))


def _pivots(level: np.ndarray, fragments: int) -> np.ndarray:
    """The places that cut the global order into fragments of about equally many occurrences."""
    share = np.cumsum(np.bincount(level, weights=2.0 ** (level / 4.0) - 1, minlength=256))
    share = share / max(share[-1], 1e-9)
    cuts = []
    for k in range(1, fragments):
        at = min(255, int(np.searchsorted(share, k / fragments)))
        before = share[at - 1] if at else 0.0
        inside = (k / fragments - before) / max(share[at] - before, 1e-9)
        cuts.append((at << 56) + min((1 << 56) - 1, int(inside * (1 << 56))))
    return np.array(cuts, dtype=np.uint64)


def _pieces(level: np.ndarray) -> np.ndarray:
    """Into how many pieces the list of a shingle is split, by the level of its cell: by how far the cell's count is above
    that of the usual cell."""
    over = 2.0 ** (np.arange(256) / 4.0) - 2.0 ** (np.median(level) / 4.0)
    return np.minimum(1 << 20, 1 + np.maximum(over, 0) // PIECE).astype(np.uint64)


def _prefixes(docs: DataFrame, levels, percent: int, buckets: int, shingle: int) -> DataFrame:
    """(bucket, rows binary): (shingle, set_id, n, place in the order, piece) of the prefixes, copies of a set within a
    batch once. Sets too small to link with any other set have none."""

    def run(batches):
        level = np.frombuffer(levels.value, dtype=np.uint8)
        pieces = _pieces(level)
        for batch in batches:
            d, h = shingle_sets(batch.column(0).to_pylist(), shingle)
            size, ids = set_ids(d, h, batch.num_rows)
            _, first = np.unique(ids, return_index=True)
            alone = np.zeros(batch.num_rows, dtype=bool)
            alone[first] = True
            keep = (alone & (100 * size >= percent * (size + 1)))[d]
            d, h = d[keep], h[keep]
            if not len(d):
                continue
            rank = _ranks(h, level)
            order = np.lexsort((rank, d))
            d, h, rank = d[order], h[order], rank[order]
            start = np.searchsorted(d, d)
            n = size[d]
            place = np.arange(len(d)) - start
            pre = np.flatnonzero(place < n - (n * percent + 99) // 100 + 1)
            d, h, place = d[pre], h[pre], place[pre].astype(np.int32)
            split = pieces[(rank[pre] >> np.uint64(56)).astype(np.int64)]
            piece = np.where(split > 1, 1 + mix(ids[d].astype(np.uint64)) % split, 0).astype(np.uint64)
            route = np.where(piece > 0, mix(h + piece), h)
            by = np.argsort(route, kind="stable")
            d, h, place, piece, route = d[by], h[by], place[by], piece[by].astype(np.int32), route[by]
            cuts = bucket_bounds(route, buckets)
            full = np.flatnonzero(np.diff(cuts))
            columns = h, ids[d], size[d].astype(np.int32), place, piece
            rows = [b"".join([x[a:b].tobytes() for x in columns]) for a, b in zip(cuts[full].tolist(), cuts[full + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "rows"])

    return docs.select("text").mapInArrow(tidy(run), "bucket int, rows binary")


def _may_link(na, nb, pa_, pb, percent: int):
    """Whether two different sets whose first common shingle is at places pa_ and pb can reach the threshold: what they
    share lies from there on, and sets of one size do not share all."""
    need = -(-percent * (na.astype(np.int64) + nb) // (100 + percent))
    return np.minimum(na - pa_, nb - pb) >= need + ((na == nb) & (pa_ == 0) & (pb == 0))


def _propose(percent: int):
    """Pairs of the short lists, stars of the long ones; the members of long lists once more for the second round."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        columns = [[], [], [], [], []]
        for x in rows["rows"]:
            n = len(x) // 28
            for k, (kind, at) in enumerate(((np.uint64, 0), (np.int64, 8), (np.int32, 16), (np.int32, 20), (np.int32, 24))):
                columns[k].append(np.frombuffer(x, kind, n, at * n))
        keys, ids, sizes, place, piece = (np.concatenate(c) for c in columns)
        order = np.lexsort((ids, piece, keys))
        keys, ids, sizes, place, piece = keys[order], ids[order], sizes[order], place[order], piece[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (piece[1:] != piece[:-1])
        fresh = new.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        keys, ids, sizes, place, piece, new = keys[fresh], ids[fresh], sizes[fresh], place[fresh], piece[fresh], new[fresh]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(keys)))
        short = np.repeat(np.where(count <= SHORT_LIST, count, 0), count)
        a, b = [first[:0]], [first[:0]]
        at = np.arange(len(keys)) - np.repeat(first, count)
        for gap in range(1, SHORT_LIST):
            i = np.flatnonzero(at + gap < short)
            a.append(i)
            b.append(i + gap)
        is_long = count > SHORT_LIST
        lens = count[is_long]
        stars = np.flatnonzero(np.repeat(is_long, count))
        if len(stars):
            at = np.concatenate(([0], np.cumsum(lens)[:-1]))
            # two centres: the set with the fewest rarer shingles, which is likest to its copies, and one that differs
            # from list to list
            own = np.repeat(np.arange(len(lens)), lens)
            score = mix(keys[stars] ^ ids[stars].astype(np.uint64))
            for order in (np.lexsort((score, place[stars] / sizes[stars], own)), np.lexsort((score, own))):
                a.append(np.repeat(stars[order[at]], lens))
                b.append(stars)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = (ids[a] != ids[b]) & _may_link(sizes[a], sizes[b], place[a], place[b], percent)
        pairs = pd.DataFrame({"a": np.minimum(ids[a[ok]], ids[b[ok]]), "b": np.maximum(ids[a[ok]], ids[b[ok]])}).drop_duplicates()
        pairs["shingle"], pairs["n"], pairs["place"] = 0, 0, 0
        # what lies in a piece has more of its list elsewhere, however short the piece is
        members = np.flatnonzero(np.repeat(is_long, count) | (piece > 0))
        return pd.concat([pairs, pd.DataFrame({"a": ids[members], "b": -1, "shingle": keys[members].astype(np.int64), "n": sizes[members], "place": place[members]})])

    return run


def _crossing(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) that may link, of different components, for the members (shingle, a, n, place, component) of lists.

    A list of more than BLOCK members is cut into bands of sizes (sets link within a band or with the next one) and each
    band into salted parts; a group of the comparison holds two parts.
    """
    width = math.log(100 / percent) * 1.0001
    lists = cut(lists.withColumn("band", F.floor(F.log("n") / width).cast("int")))
    parts = lists.groupBy("shingle", "band").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    parts = parts.groupBy("shingle").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("c") / BLOCK).cast("int")))).alias("parts"))
    parts = cut(parts.where("lo < hi").select(F.col("shingle").alias("s"), "c", "parts"))
    members = lists.join(parts, F.col("shingle") == F.col("s"))

    def with_band(step: int):
        """Blocks with the parts of the band that is `step` above."""
        n = F.coalesce(F.try_element_at("parts", F.col("band") + step), F.lit(0))
        others = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda t: t < n)
        part = F.col("part")
        if step:
            return F.transform(others, lambda t: F.struct((F.col("band") + min(step, 0)).alias("low"), F.lit(1).alias("up"), (part if step > 0 else t).alias("i"), (t if step > 0 else part).alias("j"), F.lit(int(step < 0)).alias("side")))
        return F.transform(others, lambda t: F.struct(F.col("band").alias("low"), F.lit(0).alias("up"), F.least(part, t).alias("i"), F.greatest(part, t).alias("j"), (t < part).cast("int").alias("side")))

    whole = F.array(F.struct(F.lit(-1).alias("low"), F.lit(0).alias("up"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    members = members.withColumn("part", F.pmod(F.xxhash64("a"), F.try_element_at("parts", F.col("band"))).cast("int"))
    members = members.select("shingle", "a", "n", "place", "component", F.explode(F.when(F.col("c") <= BLOCK, whole).otherwise(F.concat(*map(with_band, (0, 1, -1))))).alias("x"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["up"].iloc[0] == 0 and rows["i"].iloc[0] == rows["j"].iloc[0]
        left, right = (rows, rows) if same else (rows[rows["side"] == 0], rows[rows["side"] == 1])
        (ids, n, place, comp), (ids2, n2, place2, comp2) = ([x[c].to_numpy() for c in ("a", "n", "place", "component")] for x in (left, right))
        out = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(ids), 256):
            k = slice(lo, lo + 256)
            i, j = np.nonzero((comp[k, None] != comp2) & _may_link(n[k, None], n2, place[k, None], place2, percent))
            out.append(np.stack([np.minimum(ids[k][i], ids2[j]), np.maximum(ids[k][i], ids2[j])], 1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    return members.select("shingle", "a", "n", "place", "component", "x.*").groupBy("shingle", "low", "up", "i", "j").applyInPandas(run, "a long, b long").distinct()


def _slot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) >> np.uint64(64 - int(math.log2(FILTER_BITS)))).astype(np.int64)


def _maybe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose first column, an id, may be among ids: a filter of fixed size is gathered and sent."""
    step = FILTER_BITS // CHUNKS

    def mark(batches):
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy())] = True
        rows = [(k, zlib.compress(np.packbits(bits[k * step : (k + 1) * step]).tobytes(), 1)) for k in range(CHUNKS) if bits[k * step : (k + 1) * step].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([z for _, z in rows], pa.binary())], ["chunk", "bits"])

    def unite(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(z), dtype=np.uint8)
                sums[k] = sums[k] | own if k in sums else own
        for k, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["chunk", "bits"])

    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in ids.mapInArrow(tidy(mark), "chunk int, bits binary").repartition(CHUNKS, "chunk").mapInArrow(unite, "chunk int, bits binary").collect():
        table[r.chunk * step // 8 : (r.chunk + 1) * step // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def keep(batches):
        bits = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            at = _slot(batch.column(0).fill_null(-1).to_numpy())
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7))) & 1).cast(pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _near(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart) of the pairs that can reach the threshold by their sketches (set_id, n, sketch): sets that differ in k bits
    differ in k shingles at least. apart: the share of those in the shingles of both."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            apart = np.fromiter(map(bits_apart, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            both = (na + nb - apart) // 2
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart / (na + nb))], ["a", "b", "apart"])
            yield out.filter(pa.array(100 * both >= percent * (na + nb - both)))

    left = sketched.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = sketched.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    return met.select("a", "b", "na", "nb", "x", "y").mapInArrow(tidy(run), "a long, b long, apart double")


def _fragments(docs: DataFrame, shingle: int, levels, fragments: int) -> DataFrame:
    """(set_id, n, fragment int, shingles array<long>): a row for each fragment of the global order of the set of each row
    of docs (set_id, text); rows whose text has another set (a repeated doc_id) are left out."""

    def run(batches):
        level = np.frombuffer(levels.value, dtype=np.uint8)
        pivots = _pivots(level, fragments)
        for batch in batches:
            d, h = shingle_sets(batch.column(1).to_pylist(), shingle)
            size, own = set_ids(d, h, batch.num_rows)
            ids = batch.column(0).to_numpy()
            some = np.flatnonzero(own == ids)
            keep = (own == ids)[d]
            d, h = d[keep], h[keep]
            key = d * fragments + np.searchsorted(pivots, _ranks(h, level), "right")
            order = np.argsort(key, kind="stable")
            rows = (some[:, None] * fragments + np.arange(fragments)).reshape(-1)
            cuts = np.append(np.searchsorted(key[order], rows), len(h))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h[order].astype(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], fragments), pa.int64()), pa.array(np.repeat(size[some], fragments), pa.int64()), pa.array(rows % fragments, pa.int32()), lists], ["set_id", "n", "fragment", "shingles"])

    return docs.select("set_id", "text").mapInArrow(tidy(run), "set_id long, n long, fragment int, shingles array<long>")


def _counted(pairs: DataFrame, parts: DataFrame, fragments: range) -> DataFrame:
    """(a, b, na, nb, both, ka, kb): sizes of the sets of each pair; the overlap and the numbers of shingles in the given
    fragments, counted in each fragment by itself and summed over them."""
    pairs = pairs.select("a", "b", F.explode(F.array(*[F.lit(k) for k in fragments])).alias("fragment"))
    parts = parts.where(F.col("fragment").between(fragments[0], fragments[-1]))
    # columns of their own on both sides: Spark then shuffles parts once for the two joins
    left, right = (parts.select(F.col("set_id").alias(x), (F.col("fragment") + 0).alias("fragment"), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    met = pairs.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    met = met.select("a", "b", "fragment", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"), F.size("sa").alias("ka"), F.size("sb").alias("kb"))
    # a set may come twice, from two spellings under one doc_id
    met = met.groupBy("a", "b", "fragment", "na", "nb").agg(*[F.max(c).alias(c) for c in ("both", "ka", "kb")])
    return met.groupBy("a", "b", "na", "nb").agg(*[F.sum(c).alias(c) for c in ("both", "ka", "kb")])


def _verified(pairs: DataFrame, parts: DataFrame, percent: int, fragments: int) -> DataFrame:
    """(a, b) of the pairs whose summed overlaps reach the threshold. After the rarest fragment only those go on that can
    still reach it with all the rest of the smaller set."""
    reaches = lambda both: 100 * both >= percent * (F.col("na") + F.col("nb") - both)
    at_most = F.col("both") + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    still = cut(_counted(pairs, parts, range(1)).where(reaches(at_most)).select("a", "b", F.col("both").alias("rarest")))
    if fragments == 1:
        return still.select("a", "b")
    rest = _counted(still, parts, range(1, fragments)).join(still, ["a", "b"])
    return rest.where(reaches(F.col("both") + F.col("rarest"))).select("a", "b")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, prefix_bucket_bytes: int = PREFIX_BUCKET_BYTES, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are ignored).

    Rows link when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    reachable. Null, empty and wordless texts have no shingles and link with nothing (component_id = doc_id). Rows with a
    null doc_id are kept and never name a component: they belong to that of the rows with the same set (null if there is
    none). Repeated rows give repeated rows; the texts of a repeated doc_id are sets of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sets, level = _counts(docs, shingle)
    levels = spark.sparkContext.broadcast(level)
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(24, math.ceil(total * (100 - percent) / 100 * 28 / prefix_bucket_bytes))
    proposed = cut(_prefixes(docs, levels, percent, buckets, shingle).groupBy("bucket").applyInPandas(_propose(percent), "a long, b long, shingle long, n int, place int"))
    met = cut(proposed.where("b >= 0").select("a", "b").distinct())
    lists = proposed.where("b < 0").select("a", "shingle", "n", "place")
    wanted = met.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(lists.select(F.col("a").alias("set_id"))).distinct()
    sketched = cut(_maybe(sets.where("n > 0").select("set_id", "n", "sketch"), wanted).distinct())
    classes = sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"))

    def linked_pairs(pairs: DataFrame) -> DataFrame:
        chosen = classes.where("rep is not null").join(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id")
        chosen = cut(chosen.select("set_id", (F.col("rep") + 0).alias("rep")))
        texts = _maybe(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen.select("rep"))
        # a repeated doc_id brings all its texts; those with another set go in _fragments
        texts = texts.join(chosen, F.col("doc_id") == F.col("rep")).select("rep", "set_id", "text").dropDuplicates()
        return cut(_verified(pairs, cut(_fragments(texts, shingle, levels, fragments)), percent, fragments))

    pairs = cut(_near(met, sketched, percent))
    likest = cut(pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"))
    joined = components(linked_pairs(likest))

    def with_component(rows: DataFrame, of: str) -> DataFrame:
        known = joined.select(F.col("node").alias(of), F.col("component").alias("found"))
        return rows.join(known, of, "left").withColumn(f"component_{of}", F.coalesce("found", of)).drop("found")

    def join_more(more: DataFrame) -> DataFrame:
        if more.isEmpty():
            return joined
        return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked_pairs(more)))

    others = with_component(with_component(pairs.join(likest, ["a", "b"], "left_anti"), "a"), "b")
    joined = join_more(cut(others.where("component_a <> component_b").select("a", "b")))
    placed = with_component(lists, "a").withColumnRenamed("component_a", "component")
    joined = join_more(cut(_near(_crossing(placed, percent).join(met, ["a", "b"], "left_anti"), sketched, percent).select("a", "b")))
    # names of the linked sets, then of all; both sides of each join are tables, so that Spark can split a large component
    linked = cut(joined.join(classes.withColumnRenamed("set_id", "node"), "node").select(F.col("node").alias("set_id"), "component", "rep"))
    least = cut(linked.groupBy("component").agg(F.min("rep").alias("name")))
    named = linked.join(least, "component").select("set_id", "name")
    known = cut(classes.join(named, "set_id", "left").select((F.col("set_id") + 0).alias("k"), F.coalesce("name", "rep").alias("component_id")))
    out = sets.where("n > 0").join(known, F.col("set_id") == F.col("k")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
