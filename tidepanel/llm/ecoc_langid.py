"""Language identification with error-correcting output codes.

Each language has a codeword; for every bit a binary classifier on hashed byte n-grams (1 to 3) of the whole lower-cased
text predicts that bit. Decoding takes the codeword with the least loss, bits weighted by how well their classifier does
on training documents set aside, and flags texts whose two best codewords are close.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.store import fields_but, schema_of, small_batches
from tidepanel.llm.words import LOWER, mix

FOLDS, HELD_OUT = 4, 2
DIMENSIONS = 2048
#: Most training documents of one language, and of all.
SAMPLE_PER_LANGUAGE, SAMPLE = 800, 4000
AMBIGUOUS = 0.6
PIECE = 1 << 20
ROUNDS = 150
UNDETERMINED = "und"


def ngram_features(texts: list) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte n-grams, one row per text; whole texts."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    group, size = [], 0

    def flush():
        if not group:
            return
        joined = LOWER[np.frombuffer(b"\0\0".join(x for _, x in group) + b"\0\0", dtype=np.uint8)].astype(np.uint64)
        # an n-gram belongs to the text it starts in, and to one piece of it; two zeros end each text
        size = np.array([len(x) + 2 for _, x in group])
        place = np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)
        at = np.flatnonzero(place < np.repeat(np.minimum(size - 2, PIECE), size))
        row = np.repeat(np.arange(len(group)), size)[at]
        two = joined[:-1] << np.uint64(8) | joined[1:]
        three = two[:-1] << np.uint64(8) | joined[2:]
        ids = np.array([k for k, _ in group])
        for g, tag in ((joined, 1), (two, 2), (three, 3)):
            slot = (mix(g[at] + np.uint64(tag << 40)) % np.uint64(DIMENSIONS)).astype(np.int64)
            counts = np.bincount(row * DIMENSIONS + slot, minlength=len(group) * DIMENSIONS).reshape(len(group), DIMENSIONS)
            np.add.at(out, ids, counts.astype(np.float32))
        group.clear()

    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), PIECE):
            group.append((k, raw[at : at + PIECE + 2]))
            size += min(PIECE, len(raw) - at)
            if size >= PIECE:
                flush()
                size = 0
    flush()
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +-1: all distinct splits for up to 5 languages, else random columns with the best least distance found."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([[1.0 if c == 0 or not (split >> (c - 1)) & 1 else -1.0 for split in range(1, 2 ** (k - 1))] for c in range(k)])
    rng, best, least = np.random.default_rng(seed), None, -1
    width = math.ceil(10 * math.log2(k))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, width))
        code = code[:, np.abs(code.sum(0)) < k]
        gram = code @ code.T
        near = (code.shape[1] - np.max(gram - 2 * width * np.eye(k))) / 2
        if near > least:
            best, least = code, near
    return best


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, its share) by the weighted logistic loss of each codeword."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """One logistic classifier per bit, languages weighted equally; every fifth row only sets the trust in each bit."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    code = codewords(len(languages))
    target = code[y]
    share = np.bincount(y, minlength=len(languages))
    weight = (1.0 / share[y])[:, None]
    aside = np.arange(len(y)) % 5 == 4
    if len(y) < 50:
        aside[:] = False
    own = ~aside
    scale = 8.0
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    xs, ts, ws = x[own] * scale, target[own], weight[own] / weight[own].sum()
    for step in range(1, ROUNDS + 1):
        pull = -ts * ws / (1 + np.exp(np.clip(ts * (xs @ w + b), -50, 50)))
        for k, (g, p) in enumerate(((xs.T @ pull + 1e-4 * w, w), (pull.sum(0), b))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p -= 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    judge = aside if aside.any() else own
    right = (np.sign(x[judge] * scale @ w + b) == target[judge]).mean(0)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    return Model(languages, code, w * scale, b, trust / trust.sum() * code.shape[1])


def train(docs: DataFrame) -> Model | None:
    """Fit on a bounded sample of the training fold (doc_id, text, lang), taken by hash; None if it has no labelled row.

    A doc_id counts once for each of its languages, however often it is repeated (the text whose features come first).
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & fold)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(draw < 1.25 * SAMPLE_PER_LANGUAGE / F.col("n"))
    # an equal share of the sample for each language, at least one row, so that rare ones keep theirs
    share = sizes.agg(F.greatest(F.lit(1), F.floor(F.lit(SAMPLE) / F.count("*"))).alias("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = some.withColumn("place", place).join(F.broadcast(share)).where("place <= share").select("doc_id").distinct()

    def run(batches):
        for batch in batches:
            x = ngram_features(batch.column(0).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"lang": batch.column(1), "doc_id": batch.column(2), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    made = rows.join(F.broadcast(ids), "doc_id").select("text", "lang", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "lang string, doc_id long, x binary")
    got = made.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).select("lang", "x").toArrow()
    if not got.num_rows:
        return None
    x = np.stack([np.frombuffer(r.as_py(), dtype=np.float16) for r in got.column("x")]).astype(np.float64)
    labels = got.column("lang").to_pylist()
    order = sorted(range(len(labels)), key=lambda k: (zlib.crc32(x[k].tobytes()), labels[k]))
    return fit(x[order], [labels[k] for k in order])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs but lang_pred, score and ambiguous, then these: lang_pred string, score double, ambiguous boolean.

    `und` with score 0 where text is null or has no letter, and everywhere if nothing was learned; ambiguous where the best
    codeword has less than 0.6 of the share. Only text is looked at.
    """
    small_batches(docs.sparkSession)
    fields = fields_but(docs, ("lang_pred", "score", "ambiguous"))
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model is not None and letters.any():
                for lo in range(0, len(texts), 256):
                    best, share = model.decode(ngram_features(texts[lo : lo + 256]).astype(np.float64))
                    for k, (c, p) in enumerate(zip(best, share, strict=True), lo):
                        if letters[k]:
                            lang[k], score[k] = model.languages[c], p
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters & (score < AMBIGUOUS), pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])

    schema = schema_of(fields, "lang_pred string", "score double", "ambiguous boolean")
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
