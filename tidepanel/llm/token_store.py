"""Token-id store: concatenated ids in ascending doc_id order with Elias-Fano coded document boundaries.

A segment is one binary value: a header, the doc_ids, the boundaries and the ids in 2 or 4 bytes each. Boundaries are
split into low bits, packed, and high bits in unary; samples of the ones in the unary part answer select queries, so the
offset of any document is found without a table of 64-bit offsets. Segments are rows of a Parquet folder, which every
executor can reach whatever the store is; their order is the order of the documents.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.pool import IdPool
from tidepanel.llm.store import cut, in_order, shared_folder, small_batches

END_ID = 2
SEGMENT_TOKENS = 1 << 21
MAGIC = b"EFTOK1\0\0"
SAMPLE_BYTES = 64
#: Rows of a store: `ahead` counts the ids that its task wrote before.
SEGMENTS = "segment long, n_docs long, n_tokens long, ahead long, payload binary"
#: Tasks of a store whose sums (16 bytes each) are broadcast to its segments; beyond them Spark joins by shuffle.
BROADCAST_ROWS = 1 << 20
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(universe / n) bits each, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        low = np.packbits((values[:, None] >> np.arange(low_bits)) & 1).tobytes() if low_bits else b""
        bits = np.zeros(((top >> low_bits) + n + 8) // 8 * 8, dtype=np.uint8)
        bits[(values >> low_bits) + np.arange(n)] = 1
        high = np.packbits(bits)
        ones = np.concatenate(([0], np.cumsum(_ONES[high])))
        return cls(n, low_bits, low, high.tobytes(), ones[:-1:SAMPLE_BYTES].astype("<u4"))

    def dump(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def load(cls, data: memoryview) -> tuple[EliasFano, int]:
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        low, high = bytes(data[at : at + a]), bytes(data[at + a : at + a + b])
        samples = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, bits, low, high, samples), at + a + b + 4 * c

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        index = np.asarray(index, dtype=np.int64)
        out = np.zeros(len(index), dtype=np.int64)
        high = np.frombuffer(self.high, dtype=np.uint8)
        part = np.searchsorted(self.samples, index, side="right") - 1
        for k in np.unique(part):
            mine = part == k
            ones = np.flatnonzero(np.unpackbits(high[k * SAMPLE_BYTES : (k + 1) * SAMPLE_BYTES]))
            out[mine] = k * SAMPLE_BYTES * 8 + ones[index[mine] - int(self.samples[k])] - index[mine]
        out <<= self.low_bits
        if self.low_bits:
            at = index[:, None] * self.low_bits + np.arange(self.low_bits)
            low = np.frombuffer(self.low, dtype=np.uint8)
            out |= (((low[at >> 3] >> (7 - (at & 7))) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return out


def write_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment; null doc_ids are kept in a bit mask."""
    ends = EliasFano.build(np.concatenate(([0], np.cumsum(lengths)))).dump()
    null = np.packbits([x is None for x in doc_ids]).tobytes()
    known = np.array([0 if x is None else x for x in doc_ids], dtype="<i8").tobytes()
    return MAGIC + struct.pack("<QBQ", len(doc_ids), ids.dtype.itemsize, len(ends)) + null + known + ends + ids.tobytes()


class Segment:
    """Reader of one segment: `doc_ids`, `bounds` (Elias-Fano) and `ids`."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token segment")
        n, width, size = struct.unpack_from("<QBQ", view, 8)
        at = 8 + struct.calcsize("<QBQ")
        nulls = np.unpackbits(np.frombuffer(view, np.uint8, (n + 7) // 8, at), count=n)
        at += (n + 7) // 8
        known = np.frombuffer(view, "<i8", n, at)
        self.doc_ids = [None if z else int(x) for z, x in zip(nulls, known, strict=True)]
        self.bounds, _ = EliasFano.load(view[at + 8 * n : at + 8 * n + size])
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", offset=at + 8 * n + size)

    def offsets(self) -> np.ndarray:
        return self.bounds.select(np.arange(len(self.doc_ids) + 1))


class CachedEncoder:
    """Ids of the white-space separated chunks of texts, through a pool.

    Right for tokenizers that drop white space, never join what it separates, and lower the case.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.pool = IdPool(self._learn, np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4"))

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in chunks], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), dtype=self.pool.dtype), np.fromiter(map(len, got), dtype=np.int64, count=len(got))

    def encode(self, texts: list, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; number of ids per text)."""
        return self.pool.encode([_chunks(t) for t in texts], end_id)


def _chunks(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    # the tokenizer lowers the case anyway, but for its special tokens
    return raw.split() if b"<|" in raw else raw.lower().split()


_ENCODERS: dict[int, CachedEncoder] = {}


def _encoder(text: str) -> CachedEncoder:
    key = zlib.crc32(text.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = CachedEncoder(text)
    return _ENCODERS[key]


def store_path(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    shared_folder(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tokens-{uuid.uuid4().hex}"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode docs (doc_id, text) and write the store to path, which every executor must reach.

    Rows go in ascending doc_id order (nulls first; equal ids by text), each as its ids and then end_id; null and empty
    texts are end_id alone. No special tokens are added. The tokenizer file is sent to the executors once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        from pyspark import TaskContext

        part, seq, ahead = TaskContext.get().partitionId(), 0, 0
        encoder = _encoder(sent.value)
        docs, lens, ids, size = [], [], [], 0

        def row():
            payload = write_segment(docs, np.concatenate(lens), np.concatenate(ids))
            return pa.RecordBatch.from_pydict({"segment": pa.array([(part << 32) | seq], pa.int64()), "n_docs": pa.array([len(docs)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "ahead": pa.array([ahead], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            own, count = encoder.encode(batch.column(1).to_pylist(), end_id)
            docs += batch.column(0).to_pylist()
            lens.append(count)
            ids.append(own)
            size += len(own)
            if size >= segment_tokens:
                yield row()
                ahead += size
                docs, lens, ids, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield row()

    ordered = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<long>]) of every document of the store at path."""
    segments = spark.read.schema(SEGMENTS).parquet(path).withColumn("part", F.shiftright("segment", 32))
    # one row for each task that wrote; segments know what stands before them in their own task
    sums = cut(segments.groupBy("part").agg(F.sum("n_tokens").alias("n")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)

    def run(batches):
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seg = Segment(payload.as_buffer())
                at = seg.offsets()
                wide = seg.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                arrays = [pa.array(seg.doc_ids, pa.int64()), pa.array(at[:-1] + first, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(wide.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    joined = segments.join(base, "part").select(F.col("base") + F.col("ahead"), "payload")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
