"""Substring dedup, n-gram join and decontamination against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import ngram_join, substring_dedup, suffix_automata, wu_manber

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(docs):
    return sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))


def brute_dedup(docs, n=20):
    seen, out = set(), []
    for k, t in order(docs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode(), t is None))
    return out


@pytest.mark.parametrize("block_bytes,automata", [(300, False), (8 << 20, False), (8000, True)])
def test_dedup_equals_brute_force(frame, corpus, block_bytes, automata):
    rows = substring_dedup.dedup_passages(frame, block_bytes=block_bytes, automata=automata).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.text) for r in rows)
    assert got == sorted((str(k), n, m, sha, None if null else kept) for k, n, m, sha, kept, null in brute_dedup(corpus))
    assert rows[0].lang == "en" and all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)


def brute_sets(docs, n):
    out = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(docs, n, percent):
    sets = brute_sets(docs, n)
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted((str(k), len(s), str(least.get(top(i)) if s else k)) for i, ((k, _), s) in enumerate(zip(docs, sets, strict=True)))


def test_automata_refuse_large_references(frame, monkeypatch):
    monkeypatch.setattr(suffix_automata, "REFERENCE_BYTES", 1000)
    with pytest.raises(ValueError, match="reference"):
        substring_dedup.dedup_passages(frame, automata=True)


@pytest.mark.parametrize("n,percent,short,piece,block,fragments", [(4, 85, 8, 1 << 16, 2048, 4), (5, 80, 2, 4, 3, 1), (4, 60, 1, 4, 4, 3)])
def test_join_equals_brute_force(frame, corpus, n, percent, short, piece, block, fragments, monkeypatch):
    for name, value in (("SHORT_LIST", short), ("PIECE", piece), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = ngram_join.jaccard_components(frame, percent, n, prefix_bucket_bytes=2000, fragments=fragments).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == brute_components(corpus, n, percent)


def test_overlaps_are_summed_over_fragments(spark):
    """Each fragment alone is far from the threshold; the order of the sets' fragments is that of the global order."""
    words = [f"w{k}" for k in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:-2], "x", "y"]))]
    level = np.zeros(ngram_join.CELLS, dtype=np.uint8)
    hashes = ngram_join.shingle_sets([texts[0][1]], 4)[1]
    level[(hashes & np.uint64(ngram_join.CELLS - 1)).astype(np.int64)] = 4 + np.arange(len(hashes)) // 8
    sent = spark.sparkContext.broadcast(level.tobytes())
    ids = [int(ngram_join.set_ids(*ngram_join.shingle_sets([t], 4), 1)[1][0]) for _, t in texts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, texts, strict=True)], "set_id long, text string")
    parts = ngram_join._fragments(docs, 4, sent, 4).cache()
    ranks = [sorted(int(x) for x in ngram_join._ranks(np.array(r.shingles, dtype=np.int64).view(np.uint64), level)) for r in parts.where(F.col("set_id") == ids[0]).sort("fragment").collect()]
    assert len(ranks) == 4 and all(ranks) and sum(ranks, []) == sorted(sum(ranks, []))
    pairs = spark.createDataFrame([(min(ids), max(ids))], "a long, b long")
    each = [ngram_join._counted(pairs, parts, range(k, k + 1)).first() for k in range(4)]
    whole = ngram_join._counted(pairs, parts, range(4)).first()
    assert whole.both == sum(r.both for r in each) == 55 and whole.ka == whole.kb == 57
    assert all(r.both < 0.85 * 59 for r in each)
    assert ngram_join._verified(pairs, parts, 85, 4).count() == 1 and ngram_join._verified(pairs, parts, 95, 4).count() == 0


def test_join_of_repeated_rows_and_ids(spark):
    """A repeated doc_id with other words is a set of its own; null ids follow the rows with the same set."""
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(3, t), (3, t), (3, t.replace(" ", "  ")), (3, "quite another text under that id"), (5, t + " end"), (None, t), (None, "alone a b c d e"), (9, "quite another text under that id")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("3", 37, "3")] * 3 + [("3", 3, "3"), ("5", 38, "3"), ("None", 37, "3"), ("None", 3, "None"), ("9", 3, "3")])


def brute_hits(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            p = words(text)
            m = min(n, len(p))
            keys = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if p else ()
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in keys:
                    hit.update(range(i, i + m))
                    found.add(str(item))
        out.append((str(k), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("table_bytes", [32 << 20, 400])
def test_decontamination_equals_brute_force(spark, frame, corpus, table_bytes, monkeypatch):
    monkeypatch.setattr(wu_manber, "PIECE_WORDS", 16)
    by = dict(corpus)
    items = [(1, by[45]), (2, by[85][:400]), (10, "One, two!"), (11, "a-b_c d"), (12, None), (13, "..."), (14, by[9]), (15, by[9]), (3, "é"), (1, by[45])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = wu_manber.decontaminate(frame, bench, table_bytes=table_bytes).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == brute_hits(corpus, items)
    assert rows[0].lang == "en"


def test_empty_tables(spark, empty, frame):
    assert substring_dedup.dedup_passages(empty).count() == 0
    assert ngram_join.jaccard_components(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert wu_manber.decontaminate(empty, none).count() == 0
    assert wu_manber.decontaminate(frame, none).where("contaminated").count() == 0
