"""The pipeline against a brute-force version of its stages."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from tidepanel.llm import quality_pu

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(10)) for _ in range(n // 10))
    passage, secret = text(60), text(30)
    docs = [(k, text(rng.randint(30, 150))) for k in range(300)]
    docs += [(300 + k, " ".join(rng.choice(["buy###", "now!!", "NOW!!"]) for _ in range(80))) for k in range(60)]
    docs += [(400 + k, f"{text(60)} {passage} {text(40)}") for k in range(10)] + [(420 + k, f"{text(60)} {secret} {text(40)}") for k in range(5)]
    docs += [(500 + k, docs[k][1]) for k in range(20)] + [(530 + k, docs[k][1] + " extra words here") for k in range(20, 30)] + [(600, None)]
    labels = [(k, 0 if 300 <= k < 360 else 1, 0) for k, _ in docs if k % 2]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, secret


def sets(docs, n=5):
    out = {}
    for k, t in docs:
        w = (t or "").lower().split()
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def test_pipeline_equals_brute_force(spark, folder):
    path, docs, secret = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    model = quality_pu.train(table, spark.read.parquet(f"{path}/labels.parquet"))
    score = dict(zip([k for k, _ in docs], model.score(quality_pu.statistics([t for _, t in docs])), strict=True))
    kept = sorted((k, t) for k, t in docs if score[k] >= 0.5)
    assert sum(300 <= k < 360 for k, _ in kept) <= 3 and sum(k < 300 for k, _ in kept) >= 295
    s, group = sets(kept), {}
    for k, _ in kept:
        for j in list(group):
            both = len(s[k] & s[j])
            if both and 100 * both >= 80 * len(s[k] | s[j]):
                old, new = group[j], group.get(k, k)
                for x in [*group, k]:
                    if group.get(x, k if x == k else None) in (old, new):
                        group[x] = min(old, new)
        group.setdefault(k, k)
    kept = [(k, t) for k, t in kept if group[k] == k]
    assert not any(500 <= k < 600 for k, _ in kept)
    seen, clean = set(), []
    for k, t in kept:
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        clean.append((k, None if t is None else " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    b = words(secret)
    bench = {tuple(b[i : i + 10]) for i in range(len(b) - 9)}
    kept = [(k, t) for k, t in clean if not any(tuple(words(t)[i : i + 10]) in bench for i in range(len(words(t)) - 9))]
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((k, None if t is None else hashlib.sha256(str(lib.encode(t)).encode()).hexdigest()) for k, t in kept)
    rows = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, None if r.ids is None else hashlib.sha256(str(list(r.ids)).encode()).hexdigest()) for r in rows) == want
    assert all(r.round_trip for r in rows)


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", docs_column(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("doc_id < 0"), path).count() == 0, name


def test_near_duplicates_decide_by_row(spark, tmp_path):
    """One row of each group stays: of repeated rows, of rows without an id, and not another text under a dropped id."""
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    a, b, c = words(60, 1), words(60, 2), words(60, 3)
    rows = [(1, a), (2, a), (2, b), (5, c), (5, c), (None, a + " end"), (None, words(50, 4)), (None, words(50, 4)), (8, ""), (8, ""), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", docs_column(spark)).withColumn("ROW", docs_column(spark)).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", a), ("2", b), ("5", c), ("None", words(50, 4)), ("8", ""), ("8", ""), ("9", "None")])


def test_row_numbers_do_not_follow_the_splits(spark, tmp_path):
    """Numbers of rows are the same however many splits a job reads, and those of rows that come from no file are written."""
    rows = spark.range(20_000).selectExpr("id as doc_id", "sha2(cast(id as string), 512) as text")
    rows.repartition(4).write.option("parquet.block.size", 1 << 17).option("compression", "none").parquet(f"{tmp_path}/d")
    key, seen = "spark.sql.leafNodeDefaultParallelism", []
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for cores in ("2", "13"):
            spark.conf.set(key, cores)
            docs = spark.read.parquet(f"{tmp_path}/d")
            seen.append(({r.doc_id: r.row for r in corpus_pipeline.numbered(docs, "row").select("doc_id", "row").collect()}, docs.rdd.getNumPartitions()))
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (a, m), (b, n) = seen
    assert m != n and a == b and len(set(a.values())) == 20_000
    made = corpus_pipeline.numbered(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), "row")
    assert {r.doc_id: r.row for r in made.collect()} == {r.doc_id: r.row for r in made.collect()}


def docs_column(spark):
    from pyspark.sql import functions as F

    return F.lit("clash")
