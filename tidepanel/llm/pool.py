"""Cache of id lists by key, laid out flat so that whole texts are put together with numpy."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

LIMIT = 1_000_000
#: Keys that are learned at once.
TOGETHER = 1 << 15


class IdPool:
    """Ids of keys (words or other pieces of text), each distinct key encoded once while it stays.

    learn: list of keys -> (ids of all of them, number of ids of each). When the pool is full, keys that came once are
    forgotten.
    """

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype: np.dtype, limit: int = LIMIT):
        self.learn, self.dtype, self.limit = learn, np.dtype(dtype), limit
        self.known: dict = {}
        self.pool, self.lens, self.uses = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forget keys that came once, and the rarer ones beyond half the limit."""
        keep = self.uses > 1
        if keep.sum() > self.limit // 2:
            keep = self.uses > np.partition(self.uses, -self.limit // 2)[-self.limit // 2]
        keys = [w for w, k in zip(self.known, keep, strict=True) if k]
        self.known = {w: k for k, w in enumerate(keys)}
        self.pool, self.lens, self.uses = self.pool[np.repeat(keep, self.lens)], self.lens[keep], self.uses[keep] // 2

    def _add(self, keys: list) -> None:
        ids, lens = [self.pool], [self.lens]
        for at in range(0, len(keys), TOGETHER):
            own, count = self.learn(keys[at : at + TOGETHER])
            ids.append(own.astype(self.dtype, copy=False))
            lens.append(count)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.pool, self.lens = np.concatenate(ids), np.concatenate(lens)
        self.uses = np.concatenate((self.uses, np.zeros(len(keys), np.int64)))

    def encode(self, texts: list[list], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end if there is one; number of ids per text), texts as lists of keys."""
        if len(self.known) > self.limit:
            self.shrink()
        count = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat = list(chain.from_iterable(texts))
        words = np.fromiter(map(self.known.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        if len(miss := np.flatnonzero(words < 0)):
            fresh = [flat[k] for k in miss.tolist()]
            self._add(list(dict.fromkeys(fresh)))
            words[miss] = np.fromiter(map(self.known.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        self.uses += np.bincount(words, minlength=len(self.uses))
        # one more entry per text: its end, or nothing
        stops = np.cumsum(count + 1) - 1
        whole = np.full(len(flat) + len(texts), len(self.lens), dtype=np.int64)
        inner = np.ones(len(whole), dtype=bool)
        inner[stops] = False
        whole[inner] = words
        pool, lens = np.append(self.pool, self.dtype.type(end or 0)), np.append(self.lens, 0 if end is None else 1)
        n = lens[whole]
        at = np.repeat((np.cumsum(lens) - lens)[whole] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        total = np.concatenate(([0], np.cumsum(n)))
        return pool[at], total[stops + 1] - total[stops - count]
