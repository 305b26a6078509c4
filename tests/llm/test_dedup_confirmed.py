"""Windows of different words whose short fingerprints agree are not repeats."""

import numpy as np
import pytest

from tidepanel.llm import substring_dedup
from tidepanel.llm.words import SPACED, Words, grams

#: Pairs of 20 words with one 48-bit fingerprint, found among 60 million random windows.
PAIRS = [
    ("ba no ly sæ fæ sa fæ qi ne bi ti mo te re re mi fy qu qø mo", "do le mu so pe cø pe pæ re so ry qa ni pa co bæ jæ fo sø dø"),
    ("hy to nu ka cæ ce su ki ti dy ru ci pe ge pø qu he fy ka ju", "bu ho gi ru fæ nu qy ru dy gø ko hi ti ja bæ ka si pæ pu ce"),
]


@pytest.mark.parametrize("block_bytes", [10, 8 << 20])
def test_equal_fingerprints_of_other_words_stay(spark, block_bytes):
    for a, b in PAIRS:
        short = [grams(Words([x], SPACED).hash, 20)[0] >> np.uint64(16) for x in (a, b)]
        assert short[0] == short[1]
    (a, b), (c, d) = PAIRS
    docs = spark.createDataFrame([(1, a), (2, b), (3, c), (4, d), (5, b), (6, f"x {c} y")], "doc_id long, text string").coalesce(1)
    rows = substring_dedup.dedup_passages(docs, block_bytes=block_bytes).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20, 6: 20}
