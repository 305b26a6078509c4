"""Classifiers, language model, tokenizers and the embedding index."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import deleted_interpolation, ecoc_langid, embedding_hnsw, license_scan, quality_pu, sentencepiece_sa, store, token_store

tokenizers = pytest.importorskip("public_tokenizers")


def test_quality_on_held_out_documents(spark):
    rng = random.Random(6)
    good = lambda: ". ".join(" ".join(rng.choice(["stone", "river", "the", "of", "green", "light", "walks"]) for _ in range(12)) for _ in range(rng.randint(2, 9)))
    bad = lambda: " ".join(rng.choice(["buy###", "now!!", "NOW!!", "cheap$$$"]) for _ in range(60))
    rows = [(k, bad() if k % 4 == 0 else good(), int(k % 4 != 0)) for k in range(900)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows if k % 2] + [(k, q) for k, _, q in rows if k % 8 == 0] + [(5, None), (None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_pu.score_quality(docs, quality_pu.train(docs, labels)).collect()}
    held = [(k, q) for k, _, q in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([out[k].predicted == q for k, q in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == 903
    none = quality_pu.train(docs, labels.where("quality = 7"))
    assert none is None and quality_pu.score_quality(docs.limit(1), none).first().score == 0.5


def test_negative_risk_steps_back():
    rng = np.random.default_rng(1)
    p = rng.normal(1, 0.5, (400, 20))
    u = np.concatenate((rng.normal(1, 0.5, (300, 20)), rng.normal(-1, 0.5, (300, 20))))
    m = quality_pu.fit(p, u, 0.5)
    s = m.score(u)
    assert (s[:300] > 0.5).mean() > 0.95 and (s[300:] < 0.5).mean() > 0.95


def test_language_on_held_out_documents(spark):
    rng = random.Random(8)
    sounds = {"aa": "nthe ing of", "bb": "keit sch ung", "cc": "tion eau ère", "dd": "ción ñas lla", "ee": "żyć prz ski", "ff": "ään nen ssa"}
    rows = []
    for k in range(900):
        lang = sorted(sounds)[k % 6]
        rows.append((k, " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(2)) for _ in range(rng.randint(3, 40))), lang))
    rows += [(2000, None, "aa"), (2001, "12 34 !!", "bb"), (2002, "", None), (None, "text", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in ecoc_langid.identify(docs.select("doc_id", "text"), ecoc_langid.train(docs)).collect()}
    held = [(k, lang) for k, _, lang in rows[:900] if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([out[k].lang_pred == lang for k, lang in held]) > 0.95
    assert out[2000].lang_pred == out[2001].lang_pred == out[2002].lang_pred == "und"
    assert ecoc_langid.train(docs.where("lang = 'zz'")) is None


@pytest.mark.parametrize("k", [2, 3, 5, 9, 40])
def test_codewords_differ(k):
    code = ecoc_langid.codewords(k)
    gaps = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert min(gaps) >= (1 if k < 3 else 2 if k == 3 else 4)


def brute_lm(corpus):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(k, (t or "").translate(low).encode().split() + [None]) for k, t in corpus]
    train = [w for k, w in docs if k is not None and zlib.crc32(str(k).encode()) % 7 != 2]
    uni = collections.Counter(x for w in train for x in w)
    return docs, uni, sum(uni.values())


@pytest.mark.parametrize("block_bytes", [500, 6 << 20])
def test_base_scores_equal_brute_force(frame, corpus, block_bytes):
    docs, uni, total = brute_lm(corpus)
    want = collections.Counter()
    for k, w in docs:
        held = k is None or zlib.crc32(str(k).encode()) % 7 == 2
        base = sum(math.log10((uni[x] + 1) / (total + len(uni) + 1)) for x in w)
        want[(str(k), held, len(w), sum(uni[x] > 0 for x in w), total, round(base, 6))] += 1
    rows = deleted_interpolation.lm_scores(frame, block_bytes).collect()
    assert collections.Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want


def test_score_is_the_mixture_and_beats_the_base(spark):
    """Scores against the mixture written out, on text in which a word depends on the one before."""
    rng = random.Random(3)
    follow = {w: rng.sample("abcdefghij", 3) for w in "abcdefghij"}
    docs = []
    for k in range(400):
        w = [rng.choice("abcdefghij")]
        for _ in range(rng.randint(2, 25)):
            w.append(rng.choice(follow[w[-1]]))
        docs.append((k, " ".join(w)))
    docs.append((7777, "a zzz b"))
    rows = deleted_interpolation.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.score for r in rows if r.held_out) > 0.8 * sum(r.base_score for r in rows if r.held_out)
    train = [["<s>", *t.split(), None] for k, t in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    uni = collections.Counter(x for w in train for x in w[1:])
    two = collections.Counter((a, b) for w in train for a, b in zip(w, w[1:], strict=False))
    total, start = sum(uni.values()), len(train)
    events = collections.Counter()
    for w in train:
        for a, b in zip(w, w[1:], strict=False):
            c1, c2, c12 = (start if a == "<s>" else uni[a]) - 1, uni[b] - 1, two[a, b] - 1
            cell = (deleted_interpolation._context_bucket(np.array([c1]))[0], deleted_interpolation._log_level(np.array([c12 / max(c1, 1)]))[0], deleted_interpolation._log_level(np.array([c2 / (total - 1)]))[0])
            events[cell] += 1
    weights = mixed([(*c, n) for c, n in events.items()], len(uni))
    want = {}
    for k, t in docs:
        w, s = ["<s>", *t.split(), None], 0.0
        for a, b in zip(w, w[1:], strict=False):
            c1 = start if a == "<s>" else uni[a]
            x = weights[deleted_interpolation._context_bucket(np.array([c1]))[0]]
            s += math.log10(x[0] * two[a, b] / max(c1, 1) + x[1] * uni[b] / total + x[2] / (len(uni) + 1))
        want[k] = s
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in rows)


def mixed(rows, vocabulary):
    table = np.array(rows, dtype=float)
    return deleted_interpolation.all_weights([{"bucket": int(b), "w": deleted_interpolation.learn_weights(table[table[:, 0] == b, 1:], vocabulary)} for b in np.unique(table[:, 0])])


def test_weights_grow_with_evidence():
    rows = [(1, 255, 20, 90), (1, 8, 20, 10), (6, 4, 30, 95), (6, 255, 30, 5)]
    w = mixed(rows, 1000)
    assert w[6, 0] > w[1, 0] and np.allclose(w.sum(1), 1) and w[0, 0] == 0


def test_empty_corpora(empty):
    assert deleted_interpolation.lm_scores(empty).count() == 0
    assert sentencepiece_sa.sentencepiece_encode(empty, tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert license_scan.scan_licenses(empty, license_scan.train(empty)).count() == 0


def test_token_store_equals_the_library(spark, frame, corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for k, t in sorted(corpus, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    path = token_store.store_path(spark)
    token_store.write_tokens(frame, path, tokenizers.path("word_bpe_49k.json"), segment_tokens=500)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, list(r.ids)) for r in token_store.read_tokens(spark, path, with_ids=True).collect())
    assert got == sorted((s, k, n, c, i) for k, s, n, c, i in want)


@pytest.mark.parametrize("rows", [0, 1 << 20])
def test_token_store_of_many_small_parts(spark, frame, corpus, rows, monkeypatch):
    """Many tasks and segments, one doc_id in several of them, with and without the broadcast: offsets stay whole."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(store, "PART_BYTES", 2000)
    monkeypatch.setattr(token_store, "BROADCAST_ROWS", rows)
    docs = frame.select("doc_id", "text").unionByName(spark.createDataFrame([(5, f"w{k} and more") for k in range(300)], "doc_id long, text string"))
    path = token_store.store_path(spark)
    token_store.write_tokens(docs, path, tokenizers.path("word_bpe_49k.json"), segment_tokens=64)
    got = token_store.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert spark.read.parquet(path).selectExpr("count(distinct shiftright(segment, 32)) n").first().n > 8
    want = sorted([*corpus, *[(5, f"w{k} and more") for k in range(300)]], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [k for k, _ in want]
    plain = [x.ids + [2] for x in Tokenizer.from_file(tokenizers.path("word_bpe_49k.json")).encode_batch([t or "" for _, t in want], add_special_tokens=False)]
    assert [list(r.ids) for r in got] == plain and [r.start for r in got] == [sum(map(len, plain[:k])) for k in range(len(plain))]


def test_elias_fano_select():
    rng = np.random.default_rng(9)
    for n, top in ((1, 0), (1, 10**9), (1000, 10), (1000, 10**7), (5000, 5000)):
        x = np.sort(rng.integers(0, top + 1, n))
        ef, used = token_store.EliasFano.load(memoryview(token_store.EliasFano.build(x).dump()))
        i = rng.permutation(n)
        assert (ef.select(i) == x[i]).all() and used
    assert len(token_store.EliasFano.build(np.arange(0, 3_000_000, 300)).dump()) < 10_000 * 2


def test_sentencepiece_equals_the_library(frame, corpus):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepiece_sa.Codec(open(path, "rb").read())
    rng = random.Random(2)
    texts = ["", " ", "   ", "  a  b\n\tc ", "▁▁ x ▁", "x\x00y  ", "a" * 70, "=" * 100, "<s> </s> <0x0A>", "日本語 梦", "😀 é", *("".join(rng.choice("ab e\n=#th▁ing日") for _ in range(rng.randint(1, 150))) for _ in range(100))]
    ids, count = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == lib.encode(texts)
    want = sorted(str((k, t, None if t is None else lib.encode(t))) for k, t in corpus)
    for both in (sentencepiece_sa.sentencepiece_encode(frame, path, decoded="decoded"), sentencepiece_sa.sentencepiece_decode(sentencepiece_sa.sentencepiece_encode(frame, path), path)):
        back = both.collect()
        assert sorted(str((r.doc_id, r.text, None if r.ids is None else list(r.ids))) for r in back) == want
        assert all(r.decoded == r.text for r in back)


def test_long_units_equal_the_library():
    """Units without spaces, of more than a batch, with characters of many alphabets, with few cuts and with none."""
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepiece_sa.Codec(open(path, "rb").read())
    rng = random.Random(3)
    for text in ("a" * 300_000, "thequickbrownfox" * 5000, "".join(rng.choice("theaoinrsd") for _ in range(100_000)), "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(20_000)), "中文没有空格" * 3000, "abc1,2;x" * 20_000):
        ids, _ = codec.encode([text])
        assert ids.tolist() == lib.encode(text)


def test_decoding_of_odd_ids():
    """Broken bytes are replaced, control ids give nothing, a null list gives null; slices of a column are decoded alike."""
    import pyarrow as pa
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepiece_sa.Codec(open(path, "rb").read())
    lists = [lib.encode("one two"), None, [], [1, *lib.encode("three"), 2], [3 + 0xE9], [3 + 0xC3, 3 + 0xA9], lib.encode("  é\n日本")]
    want = [None if x is None else lib.decode(x) for x in lists]
    for lo in range(len(lists)):
        assert codec.decode(pa.array(lists, pa.list_(pa.int32())).slice(lo)).to_pylist() == want[lo:]
    assert codec.decode(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_prior_is_estimated_from_positives_and_unlabelled():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0, 1, (9000, 5)), rng.normal(2.5, 1, (9000, 5))
    for share in (0.3, 0.6, 0.85):
        n = int(6000 * share)
        unlabelled = rng.permutation(np.concatenate((good[3000 : 3000 + n], bad[: 6000 - n])))
        prior = quality_pu.estimate_prior(good[:3000], unlabelled)
        assert abs(prior - share) < 0.05
        model = quality_pu.fit(good[:3000], unlabelled, prior)
        assert share * (model.score(good[8500:]) >= 0.5).mean() + (1 - share) * (model.score(bad[8500:]) < 0.5).mean() > 0.9


def test_quality_with_positive_labels_only(spark):
    """Labels of good documents alone: the bad ones are found; repeated rows, null and long texts have scores too."""
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "morning", "walked", "garden,", "light.", "slowly"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["###", "&&&", "BUY", "!!!", "$$", "CLICK"]) for _ in range(60))
    rows = [(k, good() if k % 3 else bad()) for k in range(600)] + [(601, None), (602, ""), (603, good() * 2000), (604, bad()), (604, bad()), (None, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("SCORE", F.lit("clash"))
    labels = spark.createDataFrame([(k, 1) for k in range(600) if k % 3 and k % 2], "doc_id long, quality int")
    got = quality_pu.score_quality(docs, quality_pu.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [r.predicted == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 600]
    assert sum(right) > 0.95 * len(right)
    none = quality_pu.score_quality(docs, quality_pu.train(docs, labels.where("doc_id < 0")))
    assert {r.score for r in none.collect()} == {0.5}


def test_one_id_with_two_vectors_and_labels(spark):
    """Links of one class do not leak into another one with the same vec_id."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v, e: [x + e for x in v]
    rows = [(7, a, 1), (9, near(a, 0.01), 1), (7, b, 2), (3, near(b, 0.01), 2), (8, near(b, 0.02), 2), (5, a, 3), (5, a, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_hnsw.near_duplicates(df).collect())
    assert got == sorted([(7, 1, 7), (9, 1, 7), (7, 2, 3), (3, 2, 3), (8, 2, 3), (5, 1, 5), (5, 1, 5)])


def test_paragraphs_are_the_same_in_training_and_scan(spark):
    text = "one\ntwo\r\nthree\x0bfour\x85five\u2028six\n\nseven"
    got = spark.createDataFrame([(text,)], "text string").select(F.split("text", license_scan.PARAGRAPHS)).first()[0]
    assert got == text.splitlines()
    found = license_scan.paragraph_grams([text])
    assert found[0] == text.splitlines()


def test_licences_and_look_alikes(spark, frame):
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "The driver renewed the licence of the car."), (6, None), (7, ""), (8, "Licensed under the Grand Order of Seven Rivers License, Version 9.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = license_scan.train(frame)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs, model).collect()}
    assert [got[k].licenses for k in range(1, 8)] == [["apache-2.0"], ["mit"], ["gpl-3.0"], ["cc-by-nc-4.0"], [], [], []]
    assert got[1].n_paragraphs == 3 and got[1].found[0].paragraph == 1
    assert got[8].licenses == []


def test_licence_families_and_unknown_ones():
    """Precision and recall of each family on disturbed notices, families held out and never seen come back as unknown,
    other text as nothing."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(400)] + "the of and to in is that for it with as was on be at by this from or an are not have they which one you were all her she there would their we him been has when who will no more if out so".split() * 4
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))
    model = license_scan.Model().fit([line() for _ in range(2000)])
    assert len(model.held_out) == len(model.notices) and (model.held_out >= model.unknown_threshold).mean() >= 0.9
    told, asked, right = {}, {}, {}
    for family, notices in license_scan.TEMPLATES.items():
        for notice in notices:
            for _ in range(4):
                own = notice.split()
                if len(own) > 8:
                    own.pop(rng.randrange(len(own)))
                found = model.scan([line() + "\n# " + " ".join(own) + "\n" + line()])[1][0]
                asked[family] = asked.get(family, 0) + 1
                for paragraph, name, _ in found:
                    told[name] = told.get(name, 0) + 1
                    right[family] = right.get(family, 0) + (name == family and paragraph == 1)
    for family in license_scan.TEMPLATES:
        assert right[family] >= 0.9 * asked[family] and right[family] >= 0.9 * told[family], family
    fresh = [
        "This file is distributed under the Open Software License 3.0.",
        "This software may be used and distributed according to the terms of the Reciprocal Public License.",
        "The contents of this file are subject to the Common Public Attribution License Version 1.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Educational Community License, Version 2.0.",
        "This program is licensed under the terms of the Q Public License, version 1.0.",
        "SPDX-License-Identifier: NCSA",
        "Permission to use this software and its documentation is hereby granted, provided that the above copyright notice appears in all copies.",
        "This work is licensed under the Open Database License.",
        "Released under the Sleepycat License.",
        "You may redistribute this program under the terms of the Python Software Foundation License Version 2.",
    ]
    names = [[f[1] for f in x] for x in model.scan(fresh)[1]]
    assert sum(n == ["unknown"] for n in names) >= 0.9 * len(fresh), names
    assert sum(map(len, model.scan([line() for _ in range(3000)])[1])) == 0
    look_alikes = ["He was licensed to practise medicine in 1987.", "The author dedicated the book to the public.", "The committee granted permission to use the hall.", "A copy of the letter was distributed to all members.", "Public libraries offer free access to software.", "She wrote about the history of copyright."]
    assert sum(map(len, model.scan(look_alikes)[1])) <= 1


def vectors():
    rng = np.random.default_rng(12)
    x, label = [], []
    for c in range(3):
        for _ in range(40):
            b = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 4))):
                x.append(b + rng.normal(size=16) * 0.03)
                label.append(c)
    hub = rng.normal(size=16)
    x += [hub + rng.normal(size=16) * 0.05 for _ in range(120)] + [hub] * 30
    label += [1] * 150
    rows = [(k, [float(v) for v in e], y) for k, (e, y) in enumerate(zip(np.array(x).astype(np.float32), label, strict=True))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, rows[0][1][:8], 0), (906, [], 1), (None, rows[0][1], 0), (907, [float("inf")] * 16, 2)]
    return rows


@pytest.mark.parametrize(("shard", "partners"), [(9, 2), (40, 16), (4096, 16)])
def test_embedding_links_equal_brute_force(spark, shard, partners, monkeypatch):
    monkeypatch.setattr(embedding_hnsw, "PARTNERS", partners)
    rows = vectors()
    ok = [(k, np.array(e, dtype=np.float64), y) for k, e, y in rows if k is not None and y is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e)]
    links = {k: set() for k, _, _ in ok}
    for i, (a, x, y) in enumerate(ok):
        for b, z, w in ok[:i]:
            if y == w and len(x) == len(z) and x @ z / (np.linalg.norm(x) * np.linalg.norm(z)) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for k in sorted(links):
        if k not in comp:
            todo = [k]
            while todo:
                u = todo.pop()
                if u not in comp:
                    comp[u] = k
                    todo += links[u]
    want = sorted((str(k), len(links.get(k, ())), str(comp.get(k, k)), str(None if k is None else comp.get(k, k) == k)) for k, _, _ in rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), str(r.kept)) for r in embedding_hnsw.near_duplicates(df, shard=shard).collect())
    assert got == want
    assert embedding_hnsw.near_duplicates(df.where("vec_id < 0")).count() == 0


def planted():
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(1, 32)) + rng.normal(size=(3, 32)) * 0.05 for _ in range(400)] + [rng.normal(size=(600, 32))])
    unit = embedding_hnsw.unit_of(x)
    return unit, set(map(tuple, np.argwhere(np.triu(unit @ unit.T >= 0.98 - embedding_hnsw.SLACK, 1)).tolist()))


def test_graph_recall():
    """The searches alone find the links; without its neighbour lists the graph finds none, and all are compared."""
    unit, true = planted()
    graph = embedding_hnsw.Graph.build(unit)
    pairs, left, (audited, known, found, _) = embedding_hnsw.linked_pairs(graph, unit, True, 0.98)
    got = {(min(p), max(p)) for p in pairs.tolist() if p[0] != p[1]}
    assert len(true) > 300 and len(got & true) >= 0.99 * len(true)
    assert len(left) == 0 and audited <= embedding_hnsw.AUDIT and 0 < known and found >= 0.9 * known
    for _, links in graph.layers:
        links[:] = -1
    pairs, left, (_, known, found, compared) = embedding_hnsw.linked_pairs(graph, unit, True, 0.98)
    assert found < 0.1 * known and compared == len(left) == len(unit)
    links, edges, _ = embedding_hnsw.link_shards(graph, unit.astype(np.float64), np.ones(len(unit), np.int64), None, 0.98)
    assert abs(links.sum() - 2 * len(true)) <= 0.01 * len(true)


@pytest.mark.parametrize("emptied", [False, True])
def test_links_of_shards_count_once(emptied, monkeypatch):
    """A group larger than the widest beam, inside one shard and between two, through graphs and by comparison alone."""
    monkeypatch.setattr(embedding_hnsw, "WIDEST", 32)
    rng = np.random.default_rng(3)
    hub = rng.normal(size=24)
    x = np.concatenate((hub + rng.normal(size=(150, 24)) * 0.1, rng.normal(size=(200, 24)), hub + rng.normal(size=(30, 24)) * 0.02))
    x[200:230] = x[300:330] + rng.normal(size=(30, 24)) * 0.02
    size = rng.integers(1, 5, len(x))
    near = x @ x.T / np.linalg.norm(x, axis=1) / np.linalg.norm(x, axis=1)[:, None] >= 0.98
    np.fill_diagonal(near, False)

    def components(edges, n):
        label = np.arange(n)
        for _ in range(n):
            new = label.copy()
            np.minimum.at(new, edges[:, 0], label[edges[:, 1]])
            np.minimum.at(new, edges[:, 1], label[edges[:, 0]])
            if (new == label).all():
                return label
            label = new

    for cut in (len(x), 160):
        graph = embedding_hnsw.Graph.build(embedding_hnsw.unit_of(x[:cut]))
        if emptied:
            graph.layers = [(m, np.full_like(k, -1)) for m, k in graph.layers]
        other = None if cut == len(x) else (x[cut:], size[cut:])
        links, edges, _ = embedding_hnsw.link_shards(graph, x[:cut], size[:cut], other, 0.98)
        want = near.copy()
        if other is not None:
            want[:cut, :cut] = want[cut:, cut:] = False
        assert links.tolist() == (want @ size).tolist()
        assert (components(edges, len(x)) == components(np.argwhere(want), len(x))).all()
        assert len(edges) == len(x) - len(set(components(edges, len(x)).tolist()))


def test_magnitudes_and_exact_links(spark):
    """Huge and tiny vectors link as their directions do; exact=True gives the same; recall is reported by label."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 8))
    rows = []
    for k, v in enumerate(base):
        for m, scale in enumerate((1.0, 1e200, 1e-200, 1e-310)):
            rows.append((4 * k + m, [float(c) for c in (v + rng.normal(size=8) * 1e-3) * scale], k % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for exact in (False, True):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_hnsw.near_duplicates(df, exact=exact, shard=30).collect()}
        assert got == {k: (3, k - k % 4) for k in range(80)}
    report = embedding_hnsw.recall(df).orderBy("label").collect()
    assert [(r.label, r.audited, r.true_links, r.recall) for r in report] == [(0, 40, 120, 1.0), (1, 40, 120, 1.0)]
