"""What the similarity join sends: no texts of pairs that differ by their sketches, and not all pairs of a group of copies."""

import random

import numpy as np
import pytest
from tidepanel.llm import ngram_join


def sentence(r: random.Random) -> str:
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(60))


def sets_of(texts):
    return [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]


@pytest.fixture
def sent(monkeypatch):
    """Numbers of texts that are cut into fragments, and of pairs that are counted, in each round."""
    seen = {"texts": [], "pairs": []}
    fragments, verified = ngram_join._fragments, ngram_join._verified
    monkeypatch.setattr(ngram_join, "_fragments", lambda docs, *more: (seen["texts"].append(docs.count()), fragments(docs, *more))[1])
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *more: (seen["pairs"].append(pairs.count()), verified(pairs, *more))[1])
    return seen


def test_sketches_never_differ_by_more_than_the_sets():
    r = np.random.default_rng(3)
    for _ in range(200):
        pool = r.integers(0, 2**63, 30000, dtype=np.uint64)
        a, b = (np.unique(pool[r.integers(0, len(pool), int(2 ** r.uniform(0, 14)))]) for _ in "ab")
        if r.random() < 0.5:
            b = np.unique(np.concatenate((a[: -(-len(a) * 9 // 10)], b[: len(a) // 10])))
        d = np.repeat([0, 2], [len(a), len(b)])
        x, none, y = ngram_join.sketches(d, np.concatenate((a, b)), np.bincount(d, minlength=3)).to_pylist()
        assert none == b"" and 8 * len(x) >= min(len(a), ngram_join.SKETCH_BITS)
        assert ngram_join.bits_apart(x, y) == ngram_join.bits_apart(y, x) <= len(np.setxor1d(a, b))
        assert ngram_join.bits_apart(x, x) == 0


def test_texts_of_far_pairs_stay_where_they_are(spark, sent):
    """Twenty pairs have a rare sentence in common, which comes first in the order of both, and little else; one pair links."""
    r = random.Random(5)
    pool = [sentence(r) for _ in range(60)]
    texts = []
    for _ in range(20):
        rare = sentence(r)
        texts += [" ".join([rare, *r.sample(pool, 10)]) for _ in range(2)]
    texts += [" ".join([rare := sentence(r), *(own := r.sample(pool, 10))]), " ".join([rare, *own, "end"])]
    sets = sets_of(texts)
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert links == [(40, 41)]
    rows = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: min(k, 40) for k in range(42)}
    assert sent == {"texts": [2], "pairs": [1]}


def test_groups_of_copies_are_not_all_counted(spark, sent):
    """Groups of seven texts, each of which links with each, and a chain whose ends do not link."""
    r = random.Random(6)
    texts = []
    for _ in range(5):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join([*words, f"x{r.randrange(10**6)}"]) for _ in range(7)]
    words = [f"w{r.randrange(10**6)}" for _ in range(260)]
    texts += [" ".join(words[12 * k : 12 * k + 200]) for k in range(6)]
    rows = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: k // 7 * 7 if k < 35 else 35 for k in range(41)}
    assert sum(sent["pairs"]) == 5 * 6 + 5
