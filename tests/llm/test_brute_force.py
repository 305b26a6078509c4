"""Classifiers against versions written out plainly, and odd input of the operators that have no SQL."""

import math
import re

import numpy as np
import pytest

from tidepanel.llm import ecoc_langid, license_scan, quality_pu, sentencepiece_sa, token_store
from tidepanel.llm.words import grams, mix

tokenizers = pytest.importorskip("public_tokenizers")


def plain_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, chars = len(words), max(len(raw), 1)
    many = max(n, 1)
    several = lambda m: [tuple(words[i : i + m]) for i in range(n - m + 1)]
    distinct = lambda m: len(set(several(m))) / max(len(several(m)), 1)
    classes = [sum(c in quality_pu._CLASSES[k] for c in raw) / chars for k in ("symbols", "bars", "shouts", "capitals", "digits", "breaks", "ends", "commas")]
    share = lambda ok: sum(map(ok, words)) / many
    return [
        math.log1p(n), *classes, sum(c > 127 for c in raw) / chars, sum(map(len, words)) / many, distinct(1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / many,
        max(map(words.count, set(words)), default=0) / many, distinct(2), distinct(3), share(lambda w: 65 <= w[0] <= 90), share(lambda w: len(w) <= 2), share(lambda w: len(w) >= 16), share(lambda w: w[-1] in quality_pu._CLASSES["symbols"]),
    ]


def test_statistics_equal_the_plain_ones(corpus):
    texts = [t for _, t in corpus] + ["A# b# A# A#\n1,2; | ! é"]
    assert np.allclose(quality_pu.statistics(texts), [plain_statistics(t) for t in texts])


def test_fit_minimises_the_risk():
    """Where classes overlap and the second part stays positive, no weights nearby have a smaller risk, written out as in the
    module's docstring (and the weights' penalty); where it does not, the steps back keep it near zero."""
    rng = np.random.default_rng(3)

    def parts(model, x, y, weights, bias):
        tp, tu = (weights[model.bins(z)].sum(1) + bias for z in (x, y))
        loss = lambda t: np.log1p(np.exp(-t)).mean()
        return 0.4 * loss(tp) + 1e-4 * (weights**2).sum(), loss(-tu) - 0.4 * loss(-tp)

    p, u = rng.normal(0.3, 1, (4000, 4)), np.concatenate((rng.normal(0.3, 1, (3200, 4)), rng.normal(-0.3, 1, (4800, 4))))
    model = quality_pu.fit(p, u, 0.4)
    risk = lambda w, b: sum(parts(model, p, u, w, b))
    best = risk(model.weights, model.bias)
    assert parts(model, p, u, model.weights, model.bias)[1] > 0 and best < 0.95 * risk(np.zeros_like(model.weights), 0.0)
    for size in (0.01, 0.05, 0.3, 1.0):
        for _ in range(10):
            assert risk(model.weights + size * rng.normal(size=len(model.weights)), model.bias + size * rng.normal()) > best - 1e-4
    k = model.bins(p[:1])[0]
    assert math.isclose(model.score(p[:1])[0], 1 / (1 + math.exp(-sum(model.weights[k]) - model.bias)))
    few, mixed = rng.normal(0.8, 1, (60, 4)), np.concatenate((rng.normal(0.8, 1, (40, 4)), rng.normal(-0.8, 1, (60, 4))))
    model = quality_pu.fit(few, mixed, 0.4)
    assert abs(parts(model, few, mixed, model.weights, model.bias)[1]) < 0.05


def plain_features(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()) + b"\0\0"
    out = np.zeros(ecoc_langid.DIMENSIONS)
    for i in range(len(raw) - 2):
        for n in (1, 2, 3):
            g = np.array([int.from_bytes(raw[i : i + n], "big") + (n << 40)], dtype=np.uint64)
            out[int(mix(g)[0] % np.uint64(ecoc_langid.DIMENSIONS))] += 1
    return np.sqrt(out / max(out.sum(), 1))


@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_features_equal_the_plain_ones(piece, monkeypatch):
    """Whatever stands beside a text in its batch, and wherever long texts are cut."""
    monkeypatch.setattr(ecoc_langid, "PIECE", piece)
    texts = ["Der Rhein und die Donau fließen.", None, "", "x", "ab", "L'été, où vas-tu? " * 5, "a" * 16, "a" * 17, "a" * 18, "żyć"]
    want = np.array([plain_features(t) for t in texts])
    assert np.allclose(ecoc_langid.ngram_features(texts), want, atol=1e-6)
    assert np.allclose(ecoc_langid.ngram_features(texts[::-1]), want[::-1], atol=1e-6)


def test_decoding_equals_the_plain_one():
    rng = np.random.default_rng(1)
    code = ecoc_langid.codewords(7)
    model = ecoc_langid.Model([f"l{k}" for k in range(7)], code, rng.normal(size=(30, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape[1]))
    x = rng.normal(size=(40, 30))
    best, share = model.decode(x)
    for row, c, p in zip(x, best, share, strict=True):
        margin = [row @ model.weights[:, b] + model.bias[b] for b in range(code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m * z)) for t, m, z in zip(model.trust, margin, word, strict=True)) for word in code]
        assert c == int(np.argmin(loss)) and math.isclose(p, math.exp(-min(loss)) / sum(math.exp(-v) for v in loss), rel_tol=1e-9)


def test_licence_scan_equals_the_plain_one(frame):
    """Each paragraph by itself: n-gram counts and classes with dictionaries, the template comparison with sets."""
    model = license_scan.train(frame)
    templates = [t for f in model.families[1:] for t in license_scan.TEMPLATES[f]]
    texts = ["\n".join(["An ordinary line.", t, "", "x"]) for t in templates] + [None, "", "All rights", "The river licence was renewed.\nReleased under the Seven Rivers License, Version 9.", " ".join(templates)]
    place = {int(k): i for i, k in enumerate(model.keys)}
    number, found = model.scan(texts)
    some = 0
    for text, n, got in zip(texts, number, found, strict=True):
        lines = (text or "").splitlines()
        assert n == len(lines)
        want = []
        for at, line in enumerate(lines):
            h = license_scan.paragraph_grams([line])[2].hash
            all_grams = [int(g) for m in (1, 2, 3) if len(h) >= m for g in grams(h, m)[: len(h) - m + 1]]
            hits = [place[g] for g in all_grams if g in place]
            if not hits:
                continue
            z = sum(model.weights[i] * 4 / math.sqrt(len(all_grams)) for i in hits) + model.weights[-2] * 4 * (1 - len(hits) / len(all_grams)) + model.weights[-1]
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if 1 - p[0] >= model.threshold:
                family = model.families[int(p[1:].argmax()) + 1]
                want.append((at, family if model.confirmed(family, h) else license_scan.UNKNOWN, round(1 - p[0], 9)))
        assert [(a, f, round(s, 9)) for a, f, s in got] == want
        some += len(want)
    assert some >= 0.9 * len(templates)


def test_odd_rows_keep_their_place(spark):
    """Null, empty and very long texts, repeated rows, null ids and columns named like results in another case."""
    rows = [(1, None), (2, ""), (3, "the river " * 150_000), (4, "la rue"), (4, "la rue"), (None, "une ville"), (5, "12 %")]
    docs = spark.createDataFrame([(k, t, "fr", "clash", "clash") for k, t in rows], "doc_id long, text string, lang string, Score string, FOUND string")
    key = lambda rows: sorted((str(r.doc_id), len(r.text or "")) for r in rows)
    want = sorted((str(k), len(t or "")) for k, t in rows)
    lang = ecoc_langid.identify(docs, ecoc_langid.train(docs)).collect()
    assert key(lang) == want and {r.doc_id: r.lang_pred for r in lang} == {1: "und", 2: "und", 3: "fr", 4: "fr", None: "fr", 5: "und"}
    licences = license_scan.scan_licenses(docs, license_scan.train(docs)).collect()
    assert key(licences) == want and not any(r.found for r in licences)
    path = token_store.store_path(spark)
    token_store.write_tokens(docs, path, tokenizers.path("word_bpe_49k.json"))
    stored = token_store.read_tokens(spark, path).collect()
    assert sorted(str(r.doc_id) for r in stored) == [k for k, _ in want] and [r.n_tokens for r in stored if r.doc_id in (1, 2)] == [1, 1]
    pieces = sentencepiece_sa.sentencepiece_encode(docs, tokenizers.path("piece_bpe_32k.model"), decoded="decoded").collect()
    assert key(pieces) == want and all(r.decoded == r.text for r in pieces if r.text and "  " not in r.text)


def test_empty_tables_of_the_models(spark, empty):
    none = empty.select("doc_id", "text", "lang")
    assert ecoc_langid.identify(none, ecoc_langid.train(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_pu.train(none, labels) is None and quality_pu.score_quality(none, None).count() == 0
    path = token_store.store_path(spark)
    token_store.write_tokens(none, path, tokenizers.path("word_bpe_49k.json"))
    assert token_store.read_tokens(spark, path).count() == 0
