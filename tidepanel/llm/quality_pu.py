"""Quality classifier from positive and unlabelled documents.

The trusted positives are labelled documents of good quality, the unlabelled ones any web text. The class prior is
estimated first; then an additive model on binned text statistics minimises the non-negative unbiased risk
    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))
with the logistic loss. When the second part turns negative, the step goes back along its gradient instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import fields_but, schema_of, small_batches
from tidepanel.llm.words import SPACED, Words, grams

FOLDS, HELD_OUT = 3, 1
#: Most positives and most unlabelled documents that the classifier is fitted on, taken by hash.
POSITIVES, UNLABELLED = 12_000, 12_000
BINS = 16
ROUNDS, PRIOR_ROUNDS = 1200, 400
#: Where the estimate of the prior compares the scores: shares of the positives that lie below.
QUANTILES = np.linspace(0.02, 0.5, 25)
STATISTICS = ("length", "symbols", "bars", "shouts", "capitals", "digits", "breaks", "ends", "commas", "non_ascii", "word_length", "distinct_words", "same_again", "common_word", "distinct_pairs", "distinct_triples", "capital_words", "short_words", "long_words", "glued")
_CLASSES = {"symbols": b"#$%&*@~^_=+<>{}[]\\/", "bars": b"|", "shouts": b"!?", "capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "breaks": b"\n\r", "ends": b".", "commas": b",;:"}


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1), dtype=np.int64)
    for k, chars in enumerate(_CLASSES.values()):
        table[list(chars), k] = 1
    table[128:, -1] = 1
    return table


_TABLE = _class_table()


def statistics(texts: list) -> np.ndarray:
    """One row of text statistics per text, in the order of STATISTICS; whole texts, empty or null ones all zero."""
    words = Words(texts, SPACED)
    n, count = len(texts), np.diff(words.first)
    out = np.zeros((n, len(STATISTICS)))
    buf = np.frombuffer(words.data, dtype=np.uint8)
    lens = np.maximum(words.lengths, 1)
    for k in range(n):
        o = words.offsets[k]
        out[k, 1:10] = np.bincount(buf[o : o + words.lengths[k]], minlength=256) @ _TABLE / lens[k]
    out[:, 0] = np.log1p(count)
    doc, many = words.doc(), np.maximum(count, 1)
    size = words.end - words.start
    mean = lambda x: np.bincount(doc, weights=x, minlength=n) / many
    out[:, 10] = mean(size)
    out[:, 16] = mean((buf[words.start] >= 65) & (buf[words.start] <= 90)) if len(size) else 0
    out[:, 17], out[:, 18] = mean(size <= 2), mean(size >= 16)
    h = words.hash
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, 12] = mean(again)
    inner = words.end - 1
    out[:, 19] = mean(_TABLE[buf[inner], 0] > 0) if len(size) else 0
    left = words.left()
    for column, m in ((11, 1), (14, 2), (15, 3)):
        at = np.flatnonzero(left >= m)
        if not len(at):
            continue
        g, d = grams(h, m)[at], doc[at]
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        fresh = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        runs = np.diff(np.append(fresh, len(g)))
        total = np.bincount(d, minlength=n)
        out[:, column] = np.bincount(d[fresh], minlength=n) / np.maximum(total, 1)
        if m == 1:
            top = np.zeros(n)
            np.maximum.at(top, d[fresh], runs)
            out[:, 13] = top / many
    return out


class Model:
    """Additive model: for each statistic the edges of its bins, one weight per bin, and an intercept."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") + k * BINS for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[self.bins(x)].sum(1) + self.bias, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from these two samples alone.

    Above any threshold of a score, the share of the unlabelled is at least prior times that of the positives; the
    least ratio of both shares, each with its standard error, is the estimate. Each half is scored by a classifier fitted on the other one.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    half_p, half_u = np.arange(len(positive)) % 2 == 0, np.arange(len(unlabelled)) % 2 == 0
    sp, su = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for half in (False, True):
        model = fit(positive[half_p == half], unlabelled[half_u == half], 0.5, PRIOR_ROUNDS)
        sp[half_p != half], su[half_u != half] = model.score(positive[half_p != half]), model.score(unlabelled[half_u != half])
    at = np.quantile(sp, QUANTILES)
    above_u, above_p = (su >= at[:, None]).mean(1), (sp >= at[:, None]).mean(1)
    error = np.sqrt(above_u * (1 - above_u) / len(su) + (above_u / above_p) ** 2 * above_p * (1 - above_p) / len(sp)) / above_p
    return float((above_u / above_p + error).min())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> Model:
    """Minimise the non-negative risk with Adam; bins are quantiles of the unlabelled sample, ends made finer."""
    prior = min(max(prior, 0.01), 0.99)
    at = np.concatenate(([0.005, 0.02], np.linspace(0.06, 0.94, BINS - 5), [0.98, 0.995]))
    edges = [np.unique(np.quantile(unlabelled[:, k], at)) for k in range(unlabelled.shape[1])]
    model = Model(edges, np.zeros(BINS * len(edges)), 0.0, prior)
    bp, bu = model.bins(positive), model.bins(unlabelled)
    size = len(model.weights)
    w = np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def gradient(bins, sign):
        """Of the mean logistic loss with target `sign`, and that loss."""
        t = sign * (w[bins].sum(1) + w[-1])
        pull = -sign / (1 + np.exp(np.clip(t, -40, 40))) / len(bins)
        g = np.bincount(bins.reshape(-1), weights=np.repeat(pull, bins.shape[1]), minlength=size + 1)
        g[-1] = pull.sum()
        return g, np.logaddexp(0, -t).mean()

    for step in range(1, rounds + 1):
        up, _ = gradient(bp, 1.0)
        down, risk_p = gradient(bp, -1.0)
        free, risk_u = gradient(bu, -1.0)
        g = prior * up + (free - prior * down) if risk_u - prior * risk_p >= 0 else prior * down - free
        g[:-1] += 2e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on bounded samples of the training fold; None without positives.

    Labels only name the positives (quality = 1), and labels of bad documents are not looked at; the prior is estimated
    from the positives and the unlabelled documents. Labels with a null doc_id or quality do not count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)
    known = labels.where(fold & (F.col("quality") == 1)).select("doc_id")
    draw = F.xxhash64("doc_id")
    p = known.orderBy(draw, "doc_id").limit(POSITIVES).distinct().withColumn("kind", F.lit(1))
    u = docs.where(fold).select("doc_id").orderBy(draw, "doc_id").limit(UNLABELLED).distinct().withColumn("kind", F.lit(2))
    chosen = p.unionByName(u).groupBy("doc_id").agg(F.sum("kind").alias("kind"))

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"kind": batch.column(1), "doc_id": batch.column(2), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    made = docs.where(fold).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("kind").cast("int").alias("kind"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "kind int, doc_id long, x binary")
    # one row for each id, however often it is repeated
    got = made.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).select("kind", "x").toArrow()
    if not got.num_rows:
        return None
    kind = np.array(got.column("kind").to_pylist())
    x = np.stack([np.frombuffer(r.as_py()) for r in got.column("x")])
    order = np.lexsort((*x.T, kind))
    kind, x = kind[order], x[order]
    positive, unlabelled = x[(kind & 1) > 0], x[(kind & 2) > 0]
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled)) if len(positive) and len(unlabelled) else None


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs but score and predicted, then score double (0 to 1, higher is better) and predicted int.

    Only text is looked at; null and empty texts are scored as texts without words. Without a model every score is 0.5.
    """
    small_batches(docs.sparkSession)
    fields = fields_but(docs, ("score", "predicted"))
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            score = model.score(statistics(texts)) if model else np.full(len(texts), 0.5)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    schema = schema_of(fields, "score double", "predicted int")
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
