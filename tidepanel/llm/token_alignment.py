"""Alignment of two tokenizers: where tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) end together.

Character offsets of A and the spans that B's library reports give coarse cuts: places where both have a token that ends
with a whole character. Between two cuts, tokens that end inside a character (split multibyte characters, byte-fallback
pieces) are refined with their decoded bytes. Groups of tokens between common ends, and pairs of tokens that end together,
follow from the cuts.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import cut, pack, tidy, unpack

#: Text characters that are aligned at once.
TOGETHER = 4 << 20
#: Rows of a block of aligned documents.
BLOCK_DOCS = 1000
#: Units that a worker remembers, and the characters of a unit that is worth it.
UNITS, UNIT_CHARS = 500_000, 200
#: Characters of units that a worker remembers, and that it encodes at once (more if one unit has more).
HELD_CHARS, LEARN_CHARS = 24 << 20, 1 << 18
#: Pairs of ids whose counts are broadcast at most, 17 bytes each; what vocabularies allow is counted first.
PAIRS = 8_000_000
SPACE, MARK = " ", "▁"
_CUT = re.compile(r"(?<=\S) (?=.)", re.S)
_ODD = re.compile(r"\s |\A | \Z")
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write: printable Latin-1 stands for itself, the others follow
    from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def bytes_a(vocabulary: dict[str, int]) -> dict[int, bytes]:
    table = byte_alphabet()
    return {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in vocabulary.items()}


def bytes_b(model) -> list[bytes]:
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return [bytes([int(p[3:-1], 16)]) if model.is_byte(k) else p.replace(MARK, SPACE).encode() for k, p in enumerate(pieces)]


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many (A, B) pairs of ids can end together: of two such tokens one is a suffix of the other."""
    in_a, in_b = Counter(a), Counter(b)
    ends = lambda t, own: range(own, len(t))
    return sum(in_b[t[k:]] for t in a for k in ends(t, 0)) + sum(in_a[t[k:]] for t in b for k in ends(t, 1))


class Aligner:
    """Aligns units of text, which neither tokenizer joins with their neighbours: a space and what follows it up to the next
    space behind a character that is no white space. What was seen is remembered."""

    def __init__(self, tokenizer_json: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.of_a, self.of_b = bytes_a(self.a.get_vocab(with_added_tokens=True)), bytes_b(self.b)
        self.text_a, self.text_b = {k: str(k) for k in self.of_a}, list(map(str, range(len(self.of_b))))
        self.is_byte = [self.b.is_byte(k) for k in range(len(self.of_b))]
        self.width = len(self.of_b)
        # spaces cut texts only if no piece has one behind another character
        self.cuts = not any(SPACE in t.decode("utf-8", "replace").lstrip(SPACE) for k, t in enumerate(self.of_b) if not self.is_byte[k])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.groups: list[bytes | None] = []
        self.uses = np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_links = (np.zeros(0, np.int64) for _ in range(3))
        self.links = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forget units that came once, then the rarer ones, and long ones."""
        keep = self.uses > 1
        if keep.sum() > UNITS // 2:
            keep = self.uses > np.partition(self.uses, -UNITS // 2)[-UNITS // 2]
        keep &= np.fromiter(map(len, self.known), np.int64, len(self.known)) <= UNIT_CHARS
        self.known = {u: k for k, u in enumerate(u for u, k in zip(self.known, keep, strict=True) if k)}
        self.held = sum(map(len, self.known))
        self.groups = [g for g, k in zip(self.groups, keep, strict=True) if k]
        self.links = self.links[np.repeat(keep, self.n_links)]
        self.uses, self.n_a, self.n_b, self.n_links = (x[keep] for x in (self.uses // 2, self.n_a, self.n_b, self.n_links))

    def units(self, text: str) -> list[str]:
        """Units of a text without their first space."""
        if not self.cuts:
            return [text]
        if not _ODD.search(text):
            return text.split(SPACE)
        whole, at, out = SPACE + text, 0, []
        for m in _CUT.finditer(whole):
            out.append(whole[at + 1 : m.start()])
            at = m.start()
        return [*out, whole[at + 1 :]]

    def ends_a(self, unit: str, offsets: list[tuple[int, int]]) -> list[int]:
        """Byte place where each token of A ends; -1 for those that end inside a character, which the next one shares."""
        ends = [o[1] for o in offsets]
        if unit.isascii():
            return ends
        place = [0, *accumulate(map(len, map(str.encode, unit)))]
        starts = [o[0] for o in offsets[1:]]
        return [place[e] if s >= e else -1 for e, s in zip(ends, [*starts, ends[-1]], strict=True)]

    def ends_b(self, ids: list[int], pieces) -> list[int]:
        """The same for B; spans are bytes of the text behind the added space, empty for all but the last byte of a
        character that was spelt in bytes."""
        ends = [p.end + 1 for p in pieces]
        if any(map(self.is_byte.__getitem__, ids)):
            return [-1 if self.is_byte[p.id] and p.begin == p.end else e for p, e in zip(pieces, ends, strict=True)]
        return ends

    def align(self, unit: str, ids_a: list[int], offsets: list, ids_b: list[int], pieces) -> list[tuple[int, int]]:
        """Numbers of tokens of A and B up to each common end."""
        ends_a, ends_b = self.ends_a(unit, offsets), self.ends_b(ids_b, pieces)
        inner = -1 in ends_a and -1 in ends_b  # both have tokens that end inside a character
        place_b = {e: j for j, e in enumerate(ends_b, 1) if e >= 0}
        cuts, i, j = [], 0, 0
        for to_i, e in enumerate(ends_a, 1):
            to_j = place_b.get(e, 0) if e >= 0 else 0
            if to_j:
                if inner and to_i - i > 1 and to_j - j > 1:
                    cuts += [(i + p, j + q) for p, q in refined([self.of_a[x] for x in ids_a[i:to_i]], [self.of_b[x] for x in ids_b[j:to_j]])]
                else:
                    cuts.append((to_i, to_j))
                i, j = to_i, to_j
        return cuts

    def learn(self, units: list[str]) -> None:
        whole = [SPACE + u for u in units]
        got_a = self.a.encode_batch(whole, add_special_tokens=False)
        got_b = self.b.encode(units, return_type="proto", num_threads=1)
        of_a, of_b, text_a, text_b = self.of_a, self.of_b, self.text_a, self.text_b
        n_a, n_b, n_links, links, groups = [], [], [], [], []
        for unit, x, y in zip(whole, got_a, got_b, strict=True):
            pieces = y.pieces
            ids_a, ids_b = x.ids, [p.id for p in pieces]
            raw = unit.encode()
            n_a.append(len(ids_a))
            n_b.append(len(ids_b))
            if b"".join([of_a[k] for k in ids_a]) != raw or b"".join([of_b[k] for k in ids_b]) != raw:
                n_links.append(0)
                groups.append(None)
                continue
            if len(ids_a) == 1 or len(ids_b) == 1:
                n_links.append(1)
                links.append(ids_a[-1] * self.width + ids_b[-1])
                groups.append(f"{','.join([text_a[k] for k in ids_a])}|{','.join([text_b[k] for k in ids_b])}".encode())
                continue
            cuts = self.align(unit, ids_a, x.offsets, ids_b, pieces)
            n_links.append(len(cuts))
            i, j, parts = 0, 0, []
            for to_i, to_j in cuts:
                parts.append(f"{','.join([text_a[k] for k in ids_a[i:to_i]])}|{','.join([text_b[k] for k in ids_b[j:to_j]])}")
                links.append(ids_a[to_i - 1] * self.width + ids_b[to_j - 1])
                i, j = to_i, to_j
            groups.append(";".join(parts).encode())
        self.known.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.groups += groups
        self.held += sum(map(len, units))
        as_array = lambda x: np.array(x, dtype=np.int64)
        self.n_a, self.n_b, self.n_links = np.concatenate((self.n_a, as_array(n_a))), np.concatenate((self.n_b, as_array(n_b))), np.concatenate((self.n_links, as_array(n_links)))
        self.links = np.concatenate((self.links, as_array(links)))
        self.uses = np.concatenate((self.uses, np.zeros(len(units), np.int64)))

    def documents(self, texts: list[str | None]) -> dict[str, list]:
        """Columns of texts: n_a, n_b, n_groups, sha256, and distinct links as (A id * width + B id) with their numbers."""
        if len(self.known) > UNITS or self.held > HELD_CHARS:
            self.shrink()
        parts = [self.units(t) if t else [] for t in texts]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(miss := np.flatnonzero(at < 0)):
            fresh = [flat[k] for k in miss.tolist()]
            new = list(dict.fromkeys(fresh))
            chars = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 8)
            k = 0
            while k < len(new):
                to = max(int(np.searchsorted(chars, (chars[k - 1] if k else 0) + LEARN_CHARS, side="right")), k + 1)
                self.learn(new[k:to])
                k = to
            at[miss] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        self.uses += np.bincount(at, minlength=len(self.uses))
        stop = np.cumsum(count)
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[at])))[np.concatenate(([0], stop))])
        bad, shas, groups = np.zeros(len(texts), bool), [], self.groups
        places, k = at.tolist(), 0
        for d, n in enumerate(count.tolist()):
            own = [groups[p] for p in places[k : k + n]]
            k += n
            bad[d] = None in own
            shas.append(hashlib.sha256(b";".join(own)).digest() if n and not bad[d] else b"")
        good = np.where(bad, 0, 1)
        # links of the units of sound documents, one after the other
        use = at[np.repeat(~bad, count)]
        n = self.n_links[use]
        place = np.repeat((np.cumsum(self.n_links) - self.n_links)[use] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own = total(self.n_links) * good
        doc = np.repeat(np.arange(len(texts)), own)
        room = (max(self.of_a) + 1) * self.width
        both, times = np.unique(doc * room + self.links[place], return_counts=True)
        return {"n_a": total(self.n_a) * good, "n_b": total(self.n_b) * good, "n_groups": own, "sha": shas, "pairs": both % room, "times": times, "n_pairs": np.bincount(both // room, minlength=len(texts))}


def refined(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Numbers of tokens up to each common end of two spellings of the same bytes."""
    ends_b = {e: j for j, e in enumerate(accumulate(map(len, b)), 1)}
    return [(i, ends_b[e]) for i, e in enumerate(accumulate(map(len, a)), 1) if e in ends_b]


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(tokenizer_json: str, model: bytes) -> Aligner:
    key = zlib.crc32(model, zlib.crc32(tokenizer_json.encode()))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(tokenizer_json, model)
    return _ALIGNERS[key]


def _pieces(batches):
    """Tables of doc_id and text with at most BLOCK_DOCS rows and about TOGETHER characters."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            to = min(max(int(np.searchsorted(size, before + TOGETHER, side="right")), at + 1), at + BLOCK_DOCS)
            yield batch.slice(at, to - at)
            at = to


def aligned_blocks(docs: DataFrame, tokenizer_path: str, model_path: str) -> DataFrame:
    """(payload binary): blocks of aligned documents, compressed; written to the shared folder, so texts are read once."""
    with open(tokenizer_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        aligner = _aligner(*sent.value)
        for piece in _pieces(batches):
            x = aligner.documents(piece.column(1).to_pylist())
            offsets = pa.array(np.concatenate(([0], np.cumsum(x["n_pairs"]))), pa.int32())
            columns = {"doc_id": piece.column(0), "n_a": pa.array(x["n_a"], pa.int64()), "n_b": pa.array(x["n_b"], pa.int64()), "n_groups": pa.array(x["n_groups"], pa.int64()), "sha": pa.array(x["sha"], pa.binary())}
            columns |= {"pairs": pa.ListArray.from_arrays(offsets, pa.array(x["pairs"], pa.int64())), "times": pa.ListArray.from_arrays(offsets, pa.array(x["times"], pa.int32()))}
            yield pa.RecordBatch.from_pydict({"payload": pa.array([pack(pa.table(columns))], pa.binary())})

    return cut(docs.select("doc_id", "text").mapInArrow(tidy(run), "payload binary"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair long, n long): links of each pair of ids, combined in each task before the shuffle."""

    def run(batches):
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def combined():
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return [key], [np.bincount(inverse, np.concatenate(sums), len(key)).astype(np.int64)]

        for batch in batches:
            for payload in batch.column(0):
                table = unpack(payload.as_buffer())
                for name, out in (("pairs", keys), ("times", sums)):
                    out += [c.flatten().to_numpy().astype(np.int64) for c in table.column(name).chunks]
            if sum(map(len, keys[1:])) > 4 << 20:
                keys, sums = combined()
        keys, sums = combined()
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(sums[0], pa.int64())], ["pair", "n"])

    return blocks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, tokenizer_path: str, model_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs (doc_id, text).

    A encodes a space and the text, B the text (it adds the space); special tokens are not added and their strings are plain
    text. Null and empty texts, and texts whose bytes either does not give back, have no tokens: zeros and the empty string.
    Repeated rows count one by one; any doc_id may be null; other columns are ignored; an empty table gives an empty result.

    The number of links of every pair of ids comes to the driver and goes out as a broadcast: not more than `possible_pairs`
    of the two vocabularies however many documents there are (a few hundred thousand; over PAIRS is refused).
    """
    import sentencepiece
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    most = possible_pairs(list(bytes_a(Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True)).values()), bytes_b(model))
    if most > PAIRS:
        raise ValueError(f"the vocabularies allow {most} pairs of ids, more than {PAIRS}")
    width = model.get_piece_size()
    blocks = aligned_blocks(docs, tokenizer_path, model_path)
    counts = pair_counts(blocks).toArrow()
    pair, n = counts.column("pair").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order].astype(np.int64), n[order].astype(np.int64)
    best = np.zeros(width, np.int64)
    np.maximum.at(best, pair % width, n)
    sent = spark.sparkContext.broadcast((pair, n, n == best[pair % width]))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        pair, n, is_best = sent.value
        for batch in batches:
            for payload in batch.column(0):
                table = unpack(payload.as_buffer()).combine_chunks()
                lists = table.column("pairs").combine_chunks()
                keys, times = lists.flatten().to_numpy(), table.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
                starts, at = lists.offsets.to_numpy(), np.searchsorted(pair, keys)
                sums = lambda x, starts=starts: np.diff(np.concatenate(([0], np.cumsum(x)))[starts])
                sha = pa.array([s.hex() for s in table.column("sha").to_pylist()], pa.string())
                values = [table.column("n_a"), table.column("n_b"), table.column("n_groups"), sums(times), sums(times * is_best[at]), sums(times * n[at])]
                arrays = [table.column("doc_id").combine_chunks(), *[v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v, pa.int64()) for v in values], sha]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return blocks.mapInArrow(run, f"doc_id {id_type}, {RESULT}")
