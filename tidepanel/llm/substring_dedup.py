"""Removal of repeated passages: every word inside a window of 20 words that already occurred earlier goes.

How: documents are laid out in blocks that follow doc_id. Each block sends the fingerprints of its distinct windows to
buckets of the fingerprint space; a bucket answers each block, with one bit a window, whether another block holds the
fingerprint too. Fingerprints are short and only propose: of the windows they flag, a second exchange compares the
independent second hash (64 bits) and 32 bits of the first, and answers whether an earlier block holds both. Repeats
inside a block are found in the block, on both hashes in full. The union of the confirmed windows of a document are its
maximal spans. Exchanges of packed rows over compressed blocks; no key, however frequent, is more than one entry per
block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.exchange import bucket_bounds, decode, encode
from tidepanel.llm.store import BLOCK_BYTES, blocks, cut, fields_but, schema_of, small_batches, tidy, unpack
from tidepanel.llm.suffix_automata import earlier_windows
from tidepanel.llm.words import SPACED, Words, grams, mix

WINDOW = 20
#: Text bytes whose windows one bucket holds.
BUCKET_BYTES = 4 << 20
#: Codes and bases of the second hash.
CODES = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Bytes of words that the second hash takes at once.
PIECE = 1 << 20


def _windows(words: Words, n: int):
    """Positions of the windows that lie inside one text, and their fingerprints."""
    at = np.flatnonzero(words.left() >= n)
    return at, grams(words.hash, n)[at]


def _distinct(prints: np.ndarray, shift: int):
    """Sorted distinct fingerprints, and for each window its rank among them and whether it is the block's first."""
    keys, first, rank = np.unique(prints >> np.uint64(shift) << np.uint64(shift), return_index=True, return_inverse=True)
    fresh = np.zeros(len(prints), dtype=bool)
    fresh[first] = True
    return keys, rank, fresh


def _second(words: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Second hash of the windows that start at `at`, from the bytes of their words; independent of the fingerprints."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    lens = words.end - words.start
    buf = np.frombuffer(words.data, dtype=np.uint8)
    ids = np.flatnonzero(covered(at, n, len(lens)))
    cum = np.concatenate(([0], np.cumsum(lens[ids])))
    own = np.zeros(len(lens), dtype=np.uint64)
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(cum, cum[lo] + PIECE, side="right")) - 1)
        k, size = ids[lo:hi], lens[ids[lo:hi]]
        first = cum[lo:hi] - cum[lo]
        inner = np.arange(int(size.sum())) - np.repeat(first, size)
        powers = np.cumprod(np.full(int(size.max()), BASES[0], dtype=np.uint64))
        codes = CODES[buf[np.repeat(words.start[k], size) + inner]] * powers[inner]
        own[k] = mix(np.add.reduceat(codes, first) ^ size.astype(np.uint64))
        lo = hi
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        out = out * BASES[1] + own[at + j]
    return mix(out)


def _pairs(second: np.ndarray, prints: np.ndarray):
    """Sorted distinct (second hash, fingerprint), and for each window its rank among them and whether it is the first."""
    order = np.lexsort((np.arange(len(second)), prints, second))
    a, b = second[order], prints[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank, fresh = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=bool)
    rank[order] = np.cumsum(new) - 1
    fresh[order[new]] = True
    return a[new], b[new], rank, fresh


def _candidates(words: Words, n: int, shift: int, said: list):
    """The windows whose fingerprint occurs again: their starts, both hashes, and whether another block has the fingerprint."""
    at, prints = _windows(words, n)
    if not len(at):
        return at, prints, prints, np.zeros(0, dtype=bool)
    keys, rank, _ = _distinct(prints, shift)
    shared = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8), count=x["n"]) for x in said]).astype(bool)
    assert len(shared) == len(keys), "answers do not fit the block"
    outside = shared[rank]
    k = np.flatnonzero(outside | (np.bincount(rank)[rank] > 1))
    return at[k], prints[k], _second(words, at[k], n), outside[k]


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the words inside the windows that start at `at`."""
    steps = np.zeros(total + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def dedup_passages(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True, automata: bool = False) -> DataFrame:
    """All columns of docs, with text as the kept words joined by one space (null stays null when keep_text), and n_words
    long, n_removed long, kept_sha256 string, spans array<struct<start,end>> of removed words.

    docs holds doc_id and text; further columns pass through. A window is removed if the same words start earlier: at a
    smaller doc_id, among rows with one doc_id at the smaller text, or earlier in the text. Null doc_id sorts first. Null
    and empty texts have no words; texts shorter than the window lose nothing. Same words are 96 bits of two independent
    hashes that agree (128 inside a block). With automata, blocks are the reference shards whose
    suffix automata all documents stream past instead: words by one 64-bit hash, the same result, for small corpora.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = cut(blocks(docs, block_bytes, ordered=True))
    n_bytes = held.agg(F.sum("n_bytes")).first()[0] or 1
    # one window in 256 or fewer meets another fingerprint by accident; the second exchange sorts these out
    shift = max(0, 64 - max(32, math.ceil(math.log2(n_bytes / 4 + 2)) + 8))
    buckets = max(24, math.ceil(n_bytes / BUCKET_BYTES))

    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Words(unpack(payload.as_buffer()).column("text").to_pylist(), SPACED)
                keys, _, _ = _distinct(_windows(words, window)[1], shift)
                if not len(keys):
                    continue
                cuts = bucket_bounds(keys, buckets)
                full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([encode(keys[cuts[k] : cuts[k + 1]], shift) for k in full], pa.binary())], ["bucket", "block", "keys"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        lists = [decode(x) for x in rows["keys"]]
        keys = np.concatenate(lists)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        shared = np.zeros(len(keys), dtype=bool)
        shared[order[1:]] = same
        shared[order[:-1]] |= same
        return reply(rows, lists, shared)

    def reply(rows, lists, flags):
        bits, at = [], 0
        for x in lists:
            bits.append(np.packbits(flags[at : at + len(x)]).tobytes())
            at += len(x)
        return pd.DataFrame({"block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "n": [len(x) for x in lists], "bits": bits})

    def ask_again(batches):
        for batch in batches:
            for block, payload, said in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = Words(unpack(payload.as_buffer()).column("text").to_pylist(), SPACED)
                _, prints, second, outside = _candidates(words, window, shift, sorted(said or [], key=lambda x: x["bucket"]))
                keys, checks, _, _ = _pairs(second[outside], prints[outside])
                if not len(keys):
                    continue
                cuts = bucket_bounds(keys, buckets)
                full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                parts = [slice(cuts[k], cuts[k + 1]) for k in full]
                packed = [encode(keys[p]) for p in parts], [checks[p].astype("<u4").tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], ["bucket", "block", "keys", "checks"])

    def answer_again(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        lists = [decode(x) for x in rows["keys"]]
        keys, checks = np.concatenate(lists), np.concatenate([np.frombuffer(x, dtype="<u4") for x in rows["checks"]])
        blocks_of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.lexsort((blocks_of, checks, keys))
        k, c, b = keys[order], checks[order], blocks_of[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        earlier = np.zeros(len(k), dtype=bool)
        earlier[order] = b > b[new][np.cumsum(new) - 1]
        return reply(rows, lists, earlier)

    if automata:
        said = earlier_windows(held, window).select("block", F.lit(0).alias("bucket"), F.lit(0).alias("n"), F.col("starts").alias("bits"))
    else:
        asked = held.select("block", "payload").mapInArrow(tidy(ask), "bucket int, block long, keys binary")
        shared = asked.groupBy("bucket").applyInPandas(answer, "block long, bucket int, n int, bits binary")
        shared = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("shared"))
        # read twice, by the second question and by the end; Spark uses its exchange again
        held = held.select("block", "payload").join(shared, "block", "left")
        asked = held.select("block", "payload", "shared").mapInArrow(tidy(ask_again), "bucket int, block long, keys binary, checks binary")
        said = asked.groupBy("bucket").applyInPandas(answer_again, "block long, bucket int, n int, bits binary")
    said = said.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("said"))
    fields = fields_but(docs, ("n_words", "n_removed", "kept_sha256", "spans"))
    schema = schema_of(fields, "n_words long", "n_removed long", "kept_sha256 string", "spans array<struct<start:int,end:int>>")
    names = [f.name for f in fields]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches):
        for batch in batches:
            for payload, shared, said in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                table = unpack(payload.as_buffer())
                yield from one(table, *(sorted(x or [], key=lambda x: x["bucket"]) for x in (shared, said)))

    def repeated(words, shared, said):
        """Starts of the windows that begin earlier."""
        if automata:
            return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x["bits"], dtype=np.int64) for x in said)]))
        at, prints, second, outside = _candidates(words, window, shift, shared)
        _, _, _, fresh = _pairs(second, prints)
        gone = ~fresh
        if outside.any():
            keys, _, rank, _ = _pairs(second[outside], prints[outside])
            earlier = np.concatenate([np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8), count=x["n"]) for x in said]).astype(bool)
            assert len(earlier) == len(keys), "answers do not fit the block"
            gone[outside] |= earlier[rank]
        return at[gone]

    def one(table, shared, said):
        words = Words(table.column("text").to_pylist(), SPACED)
        gone = covered(repeated(words, shared, said), window, len(words.hash))
        nulls = table.column("text").is_null().to_pylist()
        texts, shas, spans, removed = [], [], [], []
        for k in range(table.num_rows):
            lo, hi = words.first[k], words.first[k + 1]
            out = gone[lo:hi]
            if out.any():
                kept = b" ".join([words.data[words.start[i] : words.end[i]] for i in lo + np.flatnonzero(~out)])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            else:
                kept = b" ".join(words.data[words.offsets[k] : words.offsets[k] + words.lengths[k]].split())
                spans.append([])
            shas.append(hashlib.sha256(kept).hexdigest())
            removed.append(int(out.sum()))
            if keep_text:
                texts.append(None if nulls[k] else kept.decode("utf-8", "surrogatepass"))
        arrays = [pa.array(texts, pa.string()) if n == "text" and keep_text else table.column(n).combine_chunks() for n in names]
        arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        arrays += [pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, span_type)]
        yield pa.RecordBatch.from_arrays(arrays, [*names, "n_words", "n_removed", "kept_sha256", "spans"])

    if automata:
        held = held.select("block", "payload", F.lit(None).cast("array<struct<bucket:int,n:int,bits:binary>>").alias("shared"))
    return held.join(said, "block", "left").select("payload", "shared", "said").mapInArrow(tidy(apply), schema)
