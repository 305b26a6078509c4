"""Vectorised words: spans, 64-bit word hashes and n-gram hashes of many texts at once, with numpy inside tasks.

A word is a run of bytes for which a 256-entry table is true. Texts are handled in pieces cut at separators, so memory
follows the piece and the number of words, not the longest text. Null texts have no words.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
PIECE_BYTES = 1 << 20


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for every byte outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, to be used on lower-cased text.
ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a list of texts (str, bytes or None), in order.

    `start`, `end`: byte spans in `data`; `hash`: 64-bit word hashes; `first`: index of each text's first word, with the
    total number of words at the end.
    """

    def __init__(self, texts: list, table: np.ndarray = SPACED, lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
        sep = bytes([int(np.flatnonzero(~table)[-1])])
        self.data = sep.join(raw)
        buf = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            buf = LOWER[buf]
            self.data = buf.tobytes()
        self.lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        offsets = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        starts, ends, hashes, at = [], [], [], 0
        while at < len(buf):
            to = min(at + PIECE_BYTES, len(buf))
            if to < len(buf):
                gaps = np.flatnonzero(~table[buf[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    step = PIECE_BYTES
                    while to < len(buf) and not len(gaps := np.flatnonzero(~table[buf[to : to + step]])):
                        to = min(to + step, len(buf))
                    to = to + int(gaps[0]) + 1 if to < len(buf) else to
            s, e, h = self._piece(buf[at:to], table)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = to
        empty = np.zeros(0, dtype=np.int64)
        self.start = np.concatenate(starts) if starts else empty
        self.end = np.concatenate(ends) if ends else empty
        self.hash = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        self.offsets = offsets
        self.first = np.append(np.searchsorted(self.start, offsets), len(self.start)).astype(np.int64)

    @staticmethod
    def _piece(buf: np.ndarray, table: np.ndarray):
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = table[buf]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            return s, e, np.zeros(0, dtype=np.uint64)
        longest = int((e - s).max())
        powers = np.cumprod(np.full(longest, BASE, dtype=np.uint64))
        lens = e - s
        cum = np.concatenate(([0], np.cumsum(lens)))
        at = np.arange(cum[-1]) - np.repeat(cum[:-1], lens)
        codes = BYTE_CODES[buf[inside[1:-1].astype(bool)]] * powers[at]
        return s, e, mix(np.add.reduceat(codes, cum[:-1]) + lens.astype(np.uint64))

    def doc(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]]


def grams_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """What grams has at the given positions, computed there only."""
    out = h[at]
    for k in range(1, n):
        out = out * GRAM_BASE + h[at + k]
    return mix(out + np.uint64(n))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on; positions whose window passes the end are left out."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    count = len(h) - n + 1
    out, done, part, width = None, 0, h, 1
    power = int(GRAM_BASE)
    while True:
        if n & width:
            tail = part[done : done + count]
            out = tail.copy() if out is None else out * np.uint64(power) + tail
            done += width
        if done == n:
            return mix(out + np.uint64(n))
        part = part[:-width] * np.uint64(power) + part[width:]
        power, width = power * power % (1 << 64), 2 * width
