import random

import pytest

SCHEMA = "doc_id long, text string, lang string, n_words string, score string, spans string"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = text(60), text(25)
    docs = [(k, text(rng.randint(0, 120))) for k in range(40)]
    docs += [(40 + k, f"{text(rng.randint(0, 40))} {passage}\n{text(rng.randint(0, 40))}") for k in range(15)]
    docs += [(60 + k, docs[5][1]) for k in range(12)]
    base = text(200).split()
    for k in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        docs.append((80 + k, " ".join(near)))
    docs += [(110, None), (111, ""), (112, " \t\n"), (113, "one"), (114, "One TWO"), (115, "one two"), (116, "a b c d"), (117, text(4000) + "\x0b" + line + " " + line), (118, "x" * 3000), (119, line), (3, docs[3][1]), (None, docs[7][1])]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def frame(spark, corpus):
    return spark.createDataFrame([(k, t, "en", "clash", "clash", "clash") for k, t in corpus], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
