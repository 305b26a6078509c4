"""Cut points of long jobs and blocks of documents, both in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import io
import math
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of a block.
BLOCK_BYTES = 4 << 20
#: Text bytes of a partition of ordered documents at most, on average.
PART_BYTES = 256 << 20
#: Characters of a text that ranges of documents are cut by, after doc_id.
BEGINNING = 32


def shared_folder(spark: SparkSession) -> None:
    """Set a checkpoint folder of our own only where the session names none and runs on one machine (tests, local runs)."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lost executors cost no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow whose worker gives what it freed back to the system at the end of a task: workers live on,
    and the executor's memory is that of all of them."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not with every C library
                pass

    return inner


def fields_but(frame: DataFrame, made: tuple[str, ...]) -> list:
    """Fields of frame but those that are made anew; names are compared as Spark does, without case."""
    return [f for f in frame.schema.fields if f.name.lower() not in [n.lower() for n in made]]


def schema_of(fields: list, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + list(more))


def free_name(frame: DataFrame, name: str) -> str:
    """name, or a longer one that frame has no column of."""
    while name.lower() in [c.lower() for c in frame.columns]:
        name += "_"
    return name


def pack(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue()


def unpack(payload) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def in_order(docs: DataFrame) -> DataFrame:
    """docs in ascending doc_id order (nulls first), then by text, in partitions that follow this order.

    Partitions are those of the session, or as many as PART_BYTES of text need. Different texts of one doc_id may lie in
    several: ranges are cut by how texts begin, too.
    """
    keys = F.col("doc_id"), F.substring("text", 1, BEGINNING)
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = math.ceil(n_bytes / PART_BYTES)
    if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = docs.repartitionByRange(parts, *keys)
    else:
        dealt = docs.repartitionByRange(*keys)
    return dealt.sortWithinPartitions("doc_id", "text")


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, ordered: bool = False) -> DataFrame:
    """Rows (block long, n_rows long, n_bytes long, payload binary): about block_bytes of text each, compressed.

    ordered: blocks and the rows in them follow doc_id (nulls first), then text. docs must hold doc_id and text.
    """
    if ordered:
        docs = in_order(docs)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, size, seq = [], 0, 0

        def row():
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) | seq], pa.int64()), "n_rows": pa.array([table.num_rows], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "payload": pa.array([pack(table)], pa.binary())})

        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            lens = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                cum = np.cumsum(lens[at:])
                n = max(int(np.searchsorted(cum, block_bytes - size, side="right")), 0 if held else 1)
                if n:
                    held.append(batch.slice(at, n))
                    size += int(cum[n - 1])
                    at += n
                if at < batch.num_rows or size >= block_bytes:
                    yield row()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    return docs.mapInArrow(run, "block long, n_rows long, n_bytes long, payload binary")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long: hand fewer rows at a time to Python, where the session has not chosen a number itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
