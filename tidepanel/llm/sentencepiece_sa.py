"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of spaces with the characters up to the next space; no piece crosses into the next
unit) are joined into one text. Its suffixes are sorted as far as the longest piece, every piece of the model is located
by binary search as a range of suffixes, and the occurrences, sorted by position, are the edges of a lattice. A
byte-pair model is relaxed by always taking the best edge that joins two neighbouring symbols of a unit (leftmost among
equals), a unigram model by the best path; characters that no piece covers become byte pieces. The result is that of the
model's own encoder.

Where no piece joins two neighbouring characters the unit falls into parts that are relaxed by themselves. A worker
remembers the ids of units and of their parts, and only those it does not know reach the suffix array.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.pool import IdPool
from tidepanel.llm.store import fields_but, schema_of, small_batches, tidy

SPACE = "▁"
#: Characters indexed at once.
BATCH_CHARS = 1 << 18
#: Characters of texts that are encoded together.
TEXT_CHARS = 2 << 20
#: Units and parts of units that a worker remembers.
UNITS, PARTS = 200_000, 300_000
#: Parts of more characters are relaxed with a heap, one by one.
LONG = 2000
#: Letters with the spaces before them, and runs of other characters.
LETTERS = re.compile(rf"{SPACE}*[^\W\d_]+|[\W\d_]+")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


class PieceModel:
    """Pieces of a serialized model, packed and sorted for the search."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialized)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that keep the text as it is are supported")
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        self.bpe = proto.trainer_spec.model_type == BPE
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.unknown = self.kind.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kind[k] == BYTE}
        normal = [k for k, t in enumerate(self.kind) if t == NORMAL]
        if any(SPACE in self.pieces[k].lstrip(SPACE) for k in normal):
            raise ValueError("pieces may not cross words")
        if any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for t in self.kind):
            raise ValueError("user-defined pieces are not supported")
        self.letters = sorted(set("".join(self.pieces[k] for k in normal)))
        self.code = {c: i + 1 for i, c in enumerate(self.letters)}
        self.by_point = np.zeros(0x110000, dtype=np.uint16)
        self.by_point[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
        codes = [[self.code[c] for c in self.pieces[k]] for k in normal]
        #: Pairs of neighbouring characters that some piece joins, sorted.
        self.joined = np.unique(np.array([a << 20 | b for x in codes for a, b in zip(x, x[1:], strict=False)], dtype=np.int64))
        #: Whether every piece lies within one match of LETTERS.
        self.splits = all(len(LETTERS.findall(self.pieces[k])) == 1 for k in normal)
        self.depth = max(len(self.pieces[k]) for k in normal)
        normal.sort(key=lambda k: [self.code[c] for c in self.pieces[k]])
        codes.sort()
        self.ids = np.array(normal, dtype=np.int64)
        self.length = np.array([len(self.pieces[k]) for k in normal], dtype=np.int64)
        #: Codes of the characters of each piece, 0 after its end.
        self.table = np.zeros((len(normal), self.depth), dtype=np.int64)
        for r, own in enumerate(codes):
            self.table[r, : len(own)] = own
        score = np.array([proto.pieces[k].score for k in normal])
        self.score = score
        #: Place of each piece's score among all, best first; equal scores share a place.
        self.rank = np.searchsorted(np.unique(-score), -score)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Alphabet codes of code points; 0 for characters in no piece."""
        return self.by_point[points].astype(np.int64)


def edges(model: PieceModel, codes: np.ndarray):
    """(start, piece row) of every occurrence of every piece in the coded text, sorted by start, then length.

    The characters of the text are numbered anew and packed into 64-bit words, eight together (four, if the text has more
    than 254 different ones). The suffix array is sorted by one word; pieces with more characters take the range of their
    first ones, and the rest is compared at each occurrence.
    """
    n = len(codes)
    present = np.zeros(len(model.letters) + 1, dtype=bool)
    present[codes] = True
    present[0] = False
    small = np.cumsum(present) * present
    bits = 8 if present.sum() < 255 else 16
    per = 64 // bits
    rows = np.flatnonzero((present[model.table] | (model.table == 0)).all(1))
    if not n or not len(rows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    table, length = small[model.table[rows]].astype(np.uint64), model.length[rows]
    # words[i]: the characters from i on, by doubling
    words, width = np.append(small[codes].astype(np.uint64), np.zeros(model.depth + per, np.uint64)), 1
    while width < per:
        words = words[:-width] << np.uint64(bits * width) | words[width:]
        width *= 2
    shifts = (np.uint64(bits) * np.arange(per - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    order = np.argsort(words[:n])
    ordered = words[order]
    head = table[:, :per]
    low = (head << shifts[: head.shape[1]]).sum(1, dtype=np.uint64)
    high = low | np.where(length < per, (np.uint64(1) << (np.uint64(bits) * np.maximum(per - length, 0).astype(np.uint64)) % np.uint64(64)) - np.uint64(1), np.uint64(0))
    lo, hi = np.searchsorted(ordered, low, "left"), np.searchsorted(ordered, high, "right")
    count = hi - lo
    row = np.repeat(np.arange(len(rows)), count)
    start = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    for at in range(per, model.depth, per):  # what longer pieces have beyond the first word
        some = np.flatnonzero(length[row] > at)
        if not len(some):
            break
        rest = table[:, at : at + per]
        want = (rest << shifts[: rest.shape[1]]).sum(1, dtype=np.uint64)
        free = (np.uint64(bits) * np.maximum(at + per - length, 0).astype(np.uint64)) % np.uint64(64)
        same = words[start[some] + at] >> free[row[some]] == (want >> free)[row[some]]
        keep = np.ones(len(row), dtype=bool)
        keep[some[~same]] = False
        start, row = start[keep], row[keep]
    key = np.sort(((start << 6 | length[row]) << 20) | row)
    return key >> 26, rows[key & 0xFFFFF]


def _cut_points(model: PieceModel, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bounds of units in first, and the positions of the characters that no piece joins with the one before."""
    cuts = np.zeros(len(codes) + 1, dtype=bool)
    cuts[first] = True
    pair = codes[:-1] << 20 | codes[1:]
    cuts[1:-1] |= model.joined[np.minimum(np.searchsorted(model.joined, pair), len(model.joined) - 1)] != pair
    return np.flatnonzero(cuts)


def _relax_heap(model: PieceModel, table: np.ndarray, lo: int, hi: int):
    """Byte-pair relaxation of one long part, in time that is nearly linear: (symbol starts, symbol lengths)."""
    n, width = hi - lo, model.depth + 1
    rows = memoryview(np.ascontiguousarray(table[lo:hi]).reshape(-1))
    ranks = model.rank.tolist()
    size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    twos = table[lo:hi, 2]
    some = np.flatnonzero(twos[: n - 1] >= 0)
    heap = np.sort(model.rank[twos[some]].astype(np.int64) << np.int64(32) | some).tolist()
    while heap:
        key = heapq.heappop(heap)
        i = key & 0xFFFFFFFF
        j = after[i]
        if not size[i] or j >= n:
            continue
        both = size[i] + size[j]
        row = rows[i * width + both] if both < width else -1
        if row < 0 or ranks[row] != key >> 32:
            continue
        size[i], size[j] = both, 0
        j = after[i] = after[j]
        if j < n:
            before[j] = i
            if both + size[j] < width and (row := rows[i * width + both + size[j]]) >= 0:
                heapq.heappush(heap, ranks[row] << 32 | i)
        i = before[i]
        if i >= 0 and size[i] + both < width and (row := rows[i * width + size[i] + both]) >= 0:
            heapq.heappush(heap, ranks[row] << 32 | i)
    size = np.array(size, dtype=np.int64)
    at = np.flatnonzero(size)
    return at + lo, size[at]


def _relax_pairs(model: PieceModel, first: np.ndarray, start: np.ndarray, row: np.ndarray, n: int):
    """Byte-pair relaxation of all units at once: (symbol starts, symbol lengths)."""
    table = np.full((n + 1, model.depth + 1), -1, dtype=np.int32)
    table[start, model.length[row]] = row
    none = np.int64(1) << np.int64(62)
    unit = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, size = np.arange(n), np.ones(n, dtype=np.int64)
    done_at, done_size = [], []
    lens = np.diff(first)
    for k in np.flatnonzero(lens > LONG).tolist():
        own = _relax_heap(model, table, int(first[k]), int(first[k + 1]))
        done_at.append(own[0])
        done_size.append(own[1])
    if len(done_at):
        keep = np.repeat(lens <= LONG, lens)
        at, size, unit = at[keep], size[keep], unit[keep]

    def keys(i):
        """Priority of joining symbol i with the next one."""
        both = size[i] + size[np.minimum(i + 1, len(size) - 1)]
        ok = (i + 1 < len(at)) & (both <= model.depth)
        ok &= unit[np.minimum(i + 1, len(at) - 1)] == unit[i]
        r = np.where(ok, table[at[i], np.where(ok, both, 0)], -1)
        return np.where(r >= 0, (model.rank[r].astype(np.int64) << np.int64(32)) | at[i], none)

    key = keys(np.arange(len(at))) if len(at) else np.zeros(0, np.int64)
    while len(at):
        begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(key, begin)
        live = best < none
        if not live.all():
            keep = np.repeat(live, np.diff(np.append(begin, len(at))))
            done_at.append(at[~keep])
            done_size.append(size[~keep])
            at, size, unit, key = at[keep], size[keep], unit[keep], key[keep]
            best = best[live]
            if not len(at):
                break
        left = np.searchsorted(at, best & np.int64(0xFFFFFFFF))
        size[left] += size[left + 1]
        stay = np.ones(len(at), dtype=bool)
        stay[left + 1] = False
        moved = left - np.arange(len(left))  # places after the removal: one symbol fewer per unit before
        at, size, unit, key = at[stay], size[stay], unit[stay], key[stay]
        for touched in (moved, np.maximum(moved - 1, 0)):
            key[touched] = keys(touched)
    at, size = (np.concatenate(done_at), np.concatenate(done_size)) if done_at else (at, size)
    by = np.argsort(at)
    return at[by], size[by], table


def _relax_path(model: PieceModel, first: np.ndarray, start: np.ndarray, row: np.ndarray, n: int):
    """Best path through the lattice of all units; an uncovered character costs ten less than the worst piece."""
    table = np.full((n + 1, model.depth + 1), -1, dtype=np.int32)
    table[start, model.length[row]] = row
    score, back = np.full(n + 1, -np.inf), np.ones(n + 1, dtype=np.int64)
    score[0], worst = 0.0, model.score.min() - 10
    cut = np.searchsorted(start, np.arange(n + 1))
    for i in range(n):  # no edge leaves a unit, so every path meets the ends of all units
        options = [(worst, 1)] if table[i, 1] < 0 else []
        options += [(model.score[row[e]], int(model.length[row[e]])) for e in range(cut[i], cut[i + 1])]
        for gain, m in options:
            if score[i] + gain > score[i + m]:
                score[i + m], back[i + m] = score[i] + gain, m
    at, i = [], n
    while i > 0:
        i -= int(back[i])
        at.append(i)
    at = np.array(at[::-1], dtype=np.int64)
    return at, np.diff(np.append(at, n)), table


def encode_units(model: PieceModel, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all units, number of ids of each); units are searched together."""
    out, lens, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while lo < len(units):
        hi, size = lo, 0
        while hi < len(units) and (hi == lo or size + len(units[hi]) <= BATCH_CHARS):
            size += len(units[hi])
            hi += 1
        part = units[lo:hi]
        text = "".join(part)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        first = np.concatenate(([0], np.cumsum([len(u) for u in part])))
        codes = model.codes(points)
        # a separator after each unit keeps matches inside it
        spread = np.zeros(len(codes) + len(part), dtype=np.int64)
        where = np.arange(len(codes)) + np.repeat(np.arange(len(part)), np.diff(first))
        spread[where] = codes
        start, row = edges(model, spread)
        back = np.zeros(len(spread), dtype=np.int64)
        back[where] = np.arange(len(codes))
        inner = _cut_points(model, codes, first) if len(codes) and len(model.joined) else first
        at, length, table = (_relax_pairs if model.bpe else _relax_path)(model, inner, back[start], row, len(codes))
        found = table[at, np.minimum(length, model.depth)]
        ids = model.ids[np.maximum(found, 0)]
        many = np.ones(len(ids), dtype=np.int64)
        holes = {}
        for k in np.flatnonzero(found < 0).tolist():
            raw = text[at[k] : at[k] + length[k]].encode("utf-8", "surrogatepass")
            holes[k] = [model.byte.get(b, model.unknown) for b in raw] if model.byte else [model.unknown]
            many[k] = len(holes[k])
        total = np.concatenate(([0], np.cumsum(many)))
        flat = np.empty(int(total[-1]), dtype=np.int64)
        flat[total[:-1]] = ids
        for k, own in holes.items():
            flat[total[k] : total[k + 1]] = own
        out.append(flat)
        lens.append(np.diff(total[np.searchsorted(at, first)]))
        lo = hi
    return np.concatenate(out), np.concatenate(lens)


def units_of(text: str, prefix: bool) -> list:
    """Units of a text: a run of spaces and the characters up to the next space.

    A word after one space is that word; any other unit is given as it is written for the pieces, in bytes.
    """
    if not text:
        return []
    words = text.replace(SPACE, " ").split(" ")
    if prefix and "" not in words:
        return words
    out, spaces = [], int(prefix)
    for w in words:
        if w:
            out.append(w if spaces == 1 else (SPACE * spaces + w).encode())
            spaces = 1
        else:
            spaces += 1
    if spaces > 1 or not words[-1]:
        out.append((SPACE * (spaces - 1)).encode())
    return [u for u in out if u]


class Codec:
    """Encoder with pools of units and of their parts, and decoder, for one model."""

    def __init__(self, serialized: bytes):
        self.model = PieceModel(serialized)
        self.pool = IdPool(self._learn, np.int32, UNITS)
        self.parts = IdPool(lambda parts: encode_units(self.model, parts), np.int32, PARTS)
        surface = [b"" if t in (CONTROL,) else b" \xe2\x81\x87 " if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, t in zip(self.model.pieces, self.model.kind, strict=True)]
        self.blank = np.array([not x for x in surface])
        #: Surfaces, then once more without a space at the front.
        self.surface = pa.array(surface + [x[1:] if x.startswith(b" ") else x for x in surface], pa.large_binary())

    def _learn(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        texts = [SPACE + u if isinstance(u, str) else u.decode("utf-8", "surrogatepass") for u in units]
        return self.parts.encode([LETTERS.findall(t) for t in texts]) if self.model.splits else encode_units(self.model, texts)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text); null and empty texts have none."""
        return self.pool.encode([units_of(t or "", self.model.prefix) for t in texts])

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Texts of lists of ids; null lists give null. Bytes that are no UTF-8 are replaced."""
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        ids = np.asarray(lists.values.slice(bounds[0], bounds[-1] - bounds[0]), dtype=np.int64)
        bounds = bounds - bounds[0]
        if self.model.prefix:
            at, end = bounds[:-1].copy(), bounds[1:]
            while len(skip := np.flatnonzero((at < end) & self.blank[ids[np.minimum(at, max(0, len(ids) - 1))]]) if len(ids) else at[:0]):
                at[skip] += 1
            ids = ids.copy()
            ids[at[at < end]] += len(self.blank)
        taken = self.surface.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(ids) + 1, offset=8 * taken.offset) if len(ids) else np.zeros(1, np.int64)
        data = taken.buffers()[2] if len(ids) and taken.buffers()[2] is not None else pa.py_buffer(b"")
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends[bounds].astype(np.int64)), data])
        try:
            text = raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
        return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), text.cast(pa.string())) if lists.null_count else text.cast(pa.string())


_CODECS: dict[int, Codec] = {}


def _codec(serialized: bytes) -> Codec:
    key = zlib.crc32(serialized)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(serialized)
    return _CODECS[key]


def sentencepiece_encode(docs: DataFrame, model_path: str, decoded: str | None = None) -> DataFrame:
    """All columns of docs (but ids), then ids array<int> of text, the model's own encoding without added ids; with decoded,
    also a column of that name with the text that the same task decodes from the ids.

    Null texts have null ids, empty texts empty ones. The model file is read on the driver and sent to the executors.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    made = ("ids", decoded) if decoded else ("ids",)
    fields = fields_but(docs, made)
    names = [f.name for f in fields]

    def run(batches):
        codec = _codec(sent.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            size = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(column), 0), dtype=np.int64))
            lo = 0
            while lo < batch.num_rows:
                done = int(size[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, done + TEXT_CHARS, side="right")))
                texts = column.slice(lo, hi - lo).to_pylist()
                ids, count = codec.encode(texts)
                null = np.array([t is None for t in texts] + [False])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32(), mask=null), pa.array(ids, pa.int32()))
                own = [lists, codec.decode(lists)] if decoded else [lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).slice(lo, hi - lo) for n in names), *own], [*names, *made])
                lo = hi
        for pool in (codec.pool, codec.parts):  # the worker lives on, and later stages need its memory
            pool.shrink()

    schema = schema_of(fields, "ids array<int>", *([f"`{decoded}` string"] if decoded else []))
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(tidy(run), schema)


def sentencepiece_decode(encoded: DataFrame, model_path: str, out: str = "decoded") -> DataFrame:
    """All columns of encoded (but `out`), then the text of ids; null ids give null, empty ones an empty text."""
    with open(model_path, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())
    fields = fields_but(encoded, (out,))
    names = [f.name for f in fields]

    def run(batches):
        codec = _codec(sent.value)
        for batch in batches:
            text = codec.decode(batch.column(batch.schema.get_field_index("ids")))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), text], [*names, out])

    return encoded.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(tidy(run), schema_of(fields, f"`{out}` string"))
