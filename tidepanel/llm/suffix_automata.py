"""Suffix automata of reference shards, and matching statistics of documents against them.

For references of a bounded size: a shard is a block of documents, its automaton is built in a task, brought to the
driver and broadcast, and all documents stream past it. The work is documents times shards, so references of more than
REFERENCE_BYTES of text are refused; substring_dedup says what is done instead. Words are their 64-bit hashes.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import unpack
from tidepanel.llm.words import SPACED, Words

#: Text bytes of all shards together at most.
REFERENCE_BYTES = 64 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes; each state knows where its strings end for the first time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]

    def _state(self, length: int, link: int, end: int, out: dict) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        self.first_end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the shorter strings of q, reached from p by c; they first end where q's did."""
        clone = self._state(self.length[p] + 1, self.link[q], self.first_end[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, text: list[int], at: int) -> None:
        """Append a text whose first word has position `at`; texts must come in the order of their positions."""
        last = 0
        for k, c in enumerate(text):
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, at + k, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def windows(self, text: list[int], n: int):
        """(end, first end in the shard) of every window of n words of the text that occurs in the shard."""
        v = length = 0
        nxt, link, longest = self.next, self.link, self.length
        for k, c in enumerate(text):
            while v and c not in nxt[v]:
                v = link[v]
                length = longest[v]
            if c in nxt[v]:
                v = nxt[v][c]
                length += 1
            if length >= n:
                while longest[link[v]] >= n:
                    v = link[v]
                    length = longest[v]
                yield k, self.first_end[v]


def earlier_windows(held: DataFrame, window: int, together: int = 4) -> DataFrame:
    """(block, starts binary): starts of the windows of each block (from store.blocks, ordered) that begin earlier in it or
    in an earlier block; `together` automata are broadcast at once. ValueError beyond REFERENCE_BYTES of text."""
    n_bytes = held.agg(F.sum("n_bytes")).first()[0] or 0
    if n_bytes > REFERENCE_BYTES:
        raise ValueError(f"{n_bytes} bytes of reference text are more than {REFERENCE_BYTES}")

    def build(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Words(unpack(payload.as_buffer()).column("text").to_pylist(), SPACED)
                own = SuffixAutomaton()
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    own.add(words.hash[a:b].tolist(), a)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "automaton": pa.array([pickle.dumps(own)], pa.binary())})

    def stream(sent):
        def run(batches):
            shards = [(b, pickle.loads(a)) for b, a in sent.value]
            for batch in batches:
                for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = Words(unpack(payload.as_buffer()).column("text").to_pylist(), SPACED)
                    starts = []
                    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                        text = words.hash[a:b].tolist()
                        for shard, automaton in shards:
                            if shard <= block:
                                starts += [a + k - window + 1 for k, end in automaton.windows(text, window) if shard < block or end < a + k]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "starts": pa.array([np.unique(np.array(starts, dtype=np.int64)).tobytes()], pa.binary())})

        return run

    spark, out = held.sparkSession, None
    ids = sorted(r.block for r in held.select("block").collect())
    for at in range(0, len(ids), together):
        part = ids[at : at + together]
        built = held.where(F.col("block").isin(part)).select("block", "payload").mapInArrow(build, "block long, automaton binary").collect()
        sent = spark.sparkContext.broadcast([(r.block, bytes(r.automaton)) for r in built])
        own = held.where(F.col("block") >= part[0]).select("block", "payload").mapInArrow(stream(sent), "block long, starts binary")
        out = own if out is None else out.unionByName(own)
    return out
