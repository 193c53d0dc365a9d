"""Documents as blocks, one row each, for operators that go over the same texts several times.

A block asks about keys (hashes of its words or windows): its sorted distinct keys
are cut into slices of the key space and packed, each slice is gathered from all
blocks in one task, and the answer goes back as an array in the order of the
keys.  A frequent key is one key of each block, whatever its number of
occurrences, and texts never move: blocks are written in buckets, so joining an
answer to its block shuffles the answers only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.rows import steps, text_buffer
from tidemark.plans.durable import ensure_checkpoint_dir

#: Text of a block; a longer single text is a block alone.
BLOCK_BYTES = 8 << 20


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Integers in few bytes: byte planes, compressed."""
    width = values.dtype.itemsize
    return values.dtype.str.encode() + squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    planes = np.frombuffer(unsqueeze(data[3:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys by their gaps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return squeeze(np.packbits(flags).tobytes())


def unpack_bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unsqueeze(data), np.uint8), count=count).astype(bool)


def cut_points(keys: np.ndarray, slices: int, width: int) -> np.ndarray:
    """Where sorted keys pass from slice to slice; slice ``i`` holds keys from ``i * width``."""
    return np.searchsorted(keys, np.arange(1, slices, dtype=np.uint64) * np.uint64(width))


def write_blocks(
    docs: DataFrame, text: str, columns: Sequence[str], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(block, offsets, text, columns as lists)``: blocks of whole documents, in buckets by ``block``.

    Written once into the shared folder, so a block keeps its number and rows
    whatever is lost later.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`") for c in columns])
    arrays = [(c, T.ArrayType(rows.schema[c].dataType)) for c in columns]
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("offsets", T.BinaryType()), T.StructField("text", T.BinaryType())]
        + [T.StructField(c, t) for c, t in arrays]
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = text_buffer(table.column("text"))
            lists = [
                pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks())
                for c in columns
            ]
            fixed = [pa.array([number], pa.int64()), pa.array([pack(offsets)], pa.binary()), pa.array([squeeze(data.tobytes())], pa.binary())]
            return pa.RecordBatch.from_arrays([*fixed, *lists], names=["block", "offsets", "text", *columns])

        size = 0
        for batch in steps(batches, "text", block_bytes):
            if held and size + batch.nbytes > block_bytes:
                yield block()
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield block()

    return bucketed(rows.mapInArrow(gather, schema), "block", "blocks")


def bucketed(df: DataFrame, key: str, kind: str) -> DataFrame:
    """``df`` written once into the shared folder, in buckets by ``key``: a join on the key shuffles the other side only."""
    spark = df.sparkSession
    name = f"{kind}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, key).format("parquet")
    writer.option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def texts_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of block row ``k``."""
    data = np.frombuffer(unsqueeze(batch.column("text")[k].as_py()), np.uint8)
    return data, unpack(batch.column("offsets")[k].as_py())


def answered(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """``blocks`` with its ``(block, slice, answer)`` rows as a list of ``(slice, answer)`` in slice order."""
    gathered = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slice", "answer"))).alias(name))
    return blocks.join(gathered, "block", "left")


def answers_of(batch: pa.RecordBatch, name: str, k: int) -> list[bytes]:
    """The answers of block row ``k`` in slice order."""
    return [a["answer"] for a in batch.column(name)[k].as_py() or []]
