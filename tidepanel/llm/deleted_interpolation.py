"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Maximum-likelihood estimates are mixed with weights that depend on how often the context was seen; each frequency bucket
learns its weights by expectation-maximisation on held-out counts: every training token is scored by the counts without
that token. Counts are exact and cover all training documents. Blocks send their distinct n-grams with counts to buckets
of the hash space, which add them and answer each block with the totals of its own n-grams; what travels grows with the
corpus and no frequent n-gram is more than one entry per block.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.exchange import bucket_bounds, decode, encode
from tidepanel.llm.store import blocks, cut, small_batches, tidy, unpack
from tidepanel.llm.words import GRAM_BASE, SPACED, Words, mix

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 6 << 20
START, END = np.uint64(0x5357A127), np.uint64(0xE5D0F7EC)
#: Steps per octave of the probabilities in the table from which the weights are learned.
STEPS, NEVER, LEVELS = 4, 255, 48
ROUNDS = 60
#: Weights before the first round.
WEIGHTS = (0.4, 0.4, 0.2)


def pack_counts(counts: np.ndarray) -> bytes:
    """Byte planes of non-negative integers, as many as the largest needs."""
    width = max(1, (int(counts.max()).bit_length() + 7) // 8) if len(counts) else 1
    return bytes([width]) + counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_counts(data) -> np.ndarray:
    data = bytes(data)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


class Tokens:
    """Tokens of a block: words and one end per document, as ranks of the block's distinct unigrams and bigrams."""

    def __init__(self, table: pa.Table):
        words = Words(table.column("text").to_pylist(), SPACED, lower=True)
        count = np.diff(words.first)
        self.ids = table.column("doc_id").to_pylist()
        self.train = np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS != HELD_OUT for x in self.ids], dtype=bool)
        self.first = np.concatenate(([0], np.cumsum(count + 1)))
        ends = self.first[1:] - 1
        token = np.empty(int(self.first[-1]), dtype=np.uint64)
        body = np.ones(len(token), dtype=bool)
        body[ends] = False
        token[body], token[ends] = words.hash, END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first[:-1]] = START
        self.doc = np.repeat(np.arange(len(self.ids)), count + 1)
        self.uni, self.uni_rank = np.unique(token, return_inverse=True)
        self.two, self.two_rank = np.unique(mix(before * GRAM_BASE + token), return_inverse=True)
        self.context = np.empty(len(token), dtype=np.int64)  # rank of the token before; -1 at a start
        self.context[1:] = self.uni_rank[:-1]
        self.context[self.first[:-1]] = -1

    def counts(self, kind: int) -> np.ndarray:
        """Occurrences in training documents."""
        rank, n = (self.uni_rank, len(self.uni)) if kind == 1 else (self.two_rank, len(self.two))
        return np.bincount(rank[self.train[self.doc]], minlength=n)


def _log_level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(NEVER - 1, np.round(-STEPS * np.log2(np.maximum(p, 1e-300)))), NEVER).astype(np.int64)


def _context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS - 1, np.log2(c + 1.0).astype(np.int64))


def learn_weights(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimates by expectation-maximisation over the rows (level2, level1, n) of one
    context bucket."""
    p = np.stack([np.where(cells[:, k] == NEVER, 0, 2.0 ** (-cells[:, k] / STEPS)) for k in (0, 1)] + [np.full(len(cells), 1 / (vocabulary + 1))], 1)
    w = np.array(WEIGHTS)
    for _ in range(ROUNDS):
        part = w * p
        part = part / part.sum(1, keepdims=True) * cells[:, 2:]
        w = np.maximum(part.sum(0) / cells[:, 2].sum(), 1e-6)
        w = w / w.sum()
    return w


def all_weights(learned: list) -> np.ndarray:
    """Weights of every bucket from the (bucket, weights) that were learned: a frequency that did not occur takes those of
    the nearest that did."""
    out = np.tile(np.array(WEIGHTS), (LEVELS, 1))
    if learned:
        near = np.array(sorted(x["bucket"] for x in learned))
        by = {x["bucket"]: x["w"] for x in learned}
        for b in range(LEVELS):
            out[b] = by[int(near[np.abs(near - b).argmin()])]
    out[0, 1] += out[0, 0]  # an unseen context has no bigram estimate
    out[0, 0] = 0.0
    return out


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Training rows are those whose crc32(doc_id as text) mod 7 is not 2; rows with a null doc_id are held out. Null and
    empty texts are one end token. base_score is the add-one unigram score, score the interpolated model's, both log10.
    Without training rows every estimate is uniform. Repeated rows are counted and scored each for itself; other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = cut(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_bytes))
    n_bytes = held.agg(F.sum("n_bytes")).first()[0] or 1
    buckets = {1: max(12, math.ceil(n_bytes / (4 * BUCKET_BYTES))), 2: max(24, math.ceil(n_bytes / BUCKET_BYTES))}

    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = Tokens(unpack(payload.as_buffer()))
                for kind, keys in ((1, tokens.uni), (2, tokens.two)):
                    counts, cuts = tokens.counts(kind), bucket_bounds(keys, buckets[kind])
                    full = [k for k in range(buckets[kind]) if cuts[k] < cuts[k + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([kind * 1_000_000_000 + k for k in full], pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array([encode(keys[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()), pa.array([pack_counts(counts[cuts[k] : cuts[k + 1]]) for k in full], pa.binary())], ["bucket", "block", "keys", "counts"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        counts = [unpack_counts(x) for x in rows["counts"]]
        lists = [decode(x) for x in rows["keys"]]
        keys, rank = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(rank, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
        said, at = [], 0
        for x in lists:
            said.append(pack_counts(totals[rank[at : at + len(x)]]))
            at += len(x)
        out = pd.DataFrame({"block": rows["block"].to_numpy(), "bucket": bucket, "counts": said, "distinct": 0})
        if bucket < 2_000_000_000:
            out = pd.concat([out, pd.DataFrame({"block": [-1], "bucket": [bucket], "counts": [b""], "distinct": [int((totals > 0).sum())]})])
        return out

    asked = held.select("block", "payload").mapInArrow(tidy(ask), "bucket long, block long, keys binary, counts binary")
    said = cut(asked.groupBy("bucket").applyInPandas(answer, "block long, bucket long, counts binary, distinct long"))
    vocabulary = said.where("block = -1").agg(F.sum("distinct")).first()[0] or 0

    def size_up(batches):
        for batch in batches:
            for payload in batch.column(0):
                table = unpack(payload.as_buffer())
                ids = table.column("doc_id").to_pylist()
                train = [k for k, x in enumerate(ids) if x is not None and zlib.crc32(str(x).encode()) % FOLDS != HELD_OUT]
                texts = table.column("text")
                n = sum(len((texts[k].as_py() or "").encode().split()) + 1 for k in train)
                yield pa.RecordBatch.from_pydict({"tokens": pa.array([n], pa.int64()), "docs": pa.array([len(train)], pa.int64())})

    sums = held.select("payload").mapInArrow(size_up, "tokens long, docs long").agg(F.sum("tokens"), F.sum("docs")).first()
    total, starts = sums[0] or 0, sums[1] or 0
    mine = said.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("said"))
    joined = held.join(mine, "block").select("payload", "said")

    def opened(batches):
        for batch in batches:
            weights = all_weights(batch.column(2)[0].as_py()) if batch.num_columns > 2 and batch.num_rows else None
            for payload, answers in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                tokens = Tokens(unpack(payload.as_buffer()))
                answers.sort(key=lambda x: x["bucket"])
                one, two = (np.concatenate([unpack_counts(x["counts"]) for x in answers if x["bucket"] // 1_000_000_000 == kind]) for kind in (1, 2))
                c2, c12 = one[tokens.uni_rank], two[tokens.two_rank]
                c1 = np.where(tokens.context >= 0, one[tokens.context], starts)
                yield tokens, c1, c2, c12, weights

    def events(batches):
        sums: dict = {}
        for tokens, c1, c2, c12, _ in opened(batches):
            own = tokens.train[tokens.doc]
            c1, c2, c12 = c1[own] - 1, c2[own] - 1, c12[own] - 1
            level2, level1 = _log_level(c12 / np.maximum(c1, 1)), _log_level(c2 / max(total - 1, 1))
            cells, n = np.unique((_context_bucket(c1) * 256 + level2) * 256 + level1, return_counts=True)
            for k, x in zip(cells.tolist(), n.tolist(), strict=True):
                sums[k] = sums.get(k, 0) + x
        if sums:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "w": [learn_weights(rows[["level2", "level1", "n"]].to_numpy(np.float64), vocabulary)]})

    # at most 256 * 256 rows for each of the LEVELS buckets, whatever the corpus
    seen = joined.mapInArrow(tidy(events), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    seen = seen.select(F.shiftright("cell", 16).alias("bucket"), F.shiftright("cell", 8).bitwiseAND(255).alias("level2"), F.col("cell").bitwiseAND(255).alias("level1"), "n")
    learned = seen.groupBy("bucket").applyInPandas(learn, "bucket long, w array<double>").agg(F.collect_list(F.struct("bucket", "w")).alias("learned"))
    # one query reads the joined blocks twice, and Spark uses their exchanges again
    with_weights = joined.select("payload", "said", learned.scalar().alias("learned"))

    def score(batches):
        for tokens, c1, c2, c12, weights in opened(batches):
            n = len(tokens.ids)
            base = np.log10((c2 + 1.0) / (total + 1.0 * (vocabulary + 1)))
            w = weights[_context_bucket(c1)]
            p = w[:, 0] * c12 / np.maximum(c1, 1) + w[:, 1] * c2 / max(total, 1) + w[:, 2] / (vocabulary + 1)
            sums = [np.bincount(tokens.doc, weights=x, minlength=n) for x in (base, np.log10(p))]
            known = np.bincount(tokens.doc, weights=c2 > 0, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.ids, pa.int64()), pa.array(~tokens.train, pa.bool_()), pa.array(np.diff(tokens.first), pa.int64()), pa.array(known, pa.int64()), pa.array([total] * n, pa.int64()), pa.array(sums[0], pa.float64()), pa.array(sums[1], pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_weights.mapInArrow(tidy(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
