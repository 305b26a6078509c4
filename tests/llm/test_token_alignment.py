"""Token alignment against a plain version that encodes whole texts and compares decoded bytes."""

import hashlib
import random

import pytest

from tidepanel.llm import token_alignment

tokenizers_here = pytest.importorskip("public_tokenizers")
PATHS = tokenizers_here.path("byte_bpe_50k.json"), tokenizers_here.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(libraries, docs):
    a, b = libraries
    of_a, of_b = token_alignment.bytes_a(a.get_vocab()), token_alignment.bytes_b(b)
    links, rows = {}, []
    for k, text in docs:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(of_a[t] for t in x) != raw or b"".join(of_b[t] for t in y) != raw:
            rows.append((k, 0, 0, [], ""))
            continue
        ends = []
        for ids, of in ((x, of_a), (y, of_b)):
            place, own = 0, {}
            for n, t in enumerate(ids, 1):
                place += len(of[t])
                own[place] = n
            ends.append(own)
        groups, own, i, j = [], [], 0, 0
        for place in sorted(ends[0].keys() & ends[1].keys()):
            to_i, to_j = ends[0][place], ends[1][place]
            groups.append(",".join(map(str, x[i:to_i])) + "|" + ",".join(map(str, y[j:to_j])))
            own.append((x[to_i - 1], y[to_j - 1]))
            i, j = to_i, to_j
        for pair in own:
            links[pair] = links.get(pair, 0) + 1
        rows.append((k, len(x), len(y), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, t), n in links.items():
        best[t] = max(n, best.get(t, 0))
    return sorted((str(k), n, m, len(own), len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), sha) for k, n, m, own, sha in rows)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "don't", "x1y2", "日本", "𠮷野", "€5", "--", "end.", "(a)", "👩‍👩‍👧", "ﬁ", "İ"]
    odd = list("ab \n\t'0<|>") + ["é", "▁", "　", "\x1c", "\xa0", "\x00", "\r", "<0x41>", "<s>", "<|endoftext|>", "  "]
    out = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(80)]
    out += [(100 + k, "".join(rng.choice(odd) for _ in range(rng.randint(1, 25)))) for k in range(400)]
    out += [(600, None), (601, ""), (602, " "), (603, "x "), (604, " x"), (605, "a  b"), (606, "▁"), (607, "a▁ b"), (608, "<|endoftext|>"), (None, "the end"), (5, out[5][1]), (5, out[6][1])]
    return out + [(700, "long " * 150_000), (701, "ü" * 30_000)]


def test_alignment_equals_brute_force(spark, libraries, docs, monkeypatch):
    frame = spark.createDataFrame([(*d, "clash", 7) for d in docs], "doc_id long, text string, n_a string, pairs int").repartition(3)
    got = token_alignment.align_tokenizers(frame, *PATHS).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(libraries, docs)


def test_small_pools_forget_and_learn_again(libraries, docs, monkeypatch):
    monkeypatch.setattr(token_alignment, "UNITS", 40)
    with open(PATHS[0]) as f, open(PATHS[1], "rb") as g:
        aligner = token_alignment.Aligner(f.read(), g.read())
    some = [t for _, t in docs if t is None or len(t) < 1000]
    got = []
    for k in range(0, len(some), 25):
        got += [s.hex() for s in aligner.documents(some[k : k + 25])["sha"]]
    want = {t: row[7] for t in some for row in brute(libraries, [(0, t)])}
    assert got == [want[t] for t in some]


def test_pairs_are_bounded_by_the_vocabularies(spark, libraries, docs):
    a, b = libraries
    most = token_alignment.possible_pairs(list(token_alignment.bytes_a(a.get_vocab()).values()), token_alignment.bytes_b(b))
    assert most == 324_302
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert 100 < token_alignment.pair_counts(token_alignment.aligned_blocks(frame, *PATHS)).count() < most
    assert token_alignment.possible_pairs([b"ab", b"b"], [b"b", b"cab"]) == 4


def test_empty_table(spark):
    assert token_alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
