import random
import re

import numpy as np

from tidepanel.llm import exchange, words


def test_words_are_those_of_the_patterns(monkeypatch):
    monkeypatch.setattr(words, "PIECE_BYTES", 64)
    rng = random.Random(1)
    texts = [None, "", "  ", "x" * 500, *("".join(rng.choice("aB é\t\n1-_\x85　\x00") for _ in range(rng.randint(0, 300))) for _ in range(200))]
    for table, pattern, lower in ((words.SPACED, rb"[^\x20\x09-\x0D]+", False), (words.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = words.Words(texts, table, lower)
        for k, t in enumerate(texts):
            raw = (t or "").encode()
            raw = raw.translate(bytes(words.LOWER)) if lower else raw
            assert [w.word(i) for i in range(w.first[k], w.first[k + 1])] == re.findall(pattern, raw)
        by = {}
        for i in range(len(w.hash)):
            assert by.setdefault(w.word(i), w.hash[i]) == w.hash[i]
        assert len(set(by.values())) == len(by)


def test_grams_depend_on_the_window_alone():
    h = np.array([3, 1, 4, 1, 5, 3, 1, 4, 1, 5, 9], dtype=np.uint64)
    for n in range(1, 12):
        g = words.grams(h, n)
        assert len(g) == 12 - n
        for i in range(len(g)):
            for j in range(len(g)):
                assert (g[i] == g[j]) == (h[i : i + n].tolist() == h[j : j + n].tolist())


def test_key_lists_round_trip():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (exchange.decode(exchange.encode(keys)) == keys).all()
    short = np.unique(keys >> np.uint64(16))
    assert (exchange.decode(exchange.encode(short << np.uint64(16), 16)) == short).all()
    assert len(exchange.decode(b"")) == 0
    cuts = exchange.bucket_bounds(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == len(keys) and (np.diff(cuts) >= 0).all()
