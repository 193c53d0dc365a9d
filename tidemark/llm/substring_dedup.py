"""Passages that repeat, within a document or anywhere else, taken out of all documents.

A passage repeats if a window of consecutive words starts at two places.  First
each block of documents makes a sketch of its windows, two rows of counters that
stop at 2; the sketches are merged slice by slice, which never counts too few.
Then only windows that both rows count twice are grouped exactly, by 96 bits of
hash; a window that a sketch over-counted drops out there.

The sketch is as wide as there are windows, so the share of windows that
collisions let through stays alike at every size.  Blocks send counters they
touched, not whole sketches, and get back one bit for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.words import hash_words, mixed, spans
from tidemark.plans.durable import cut

WINDOW = 35
#: Counters of a sketch row for each window.
COUNTERS = 4
#: Counters of a slice at most.
SLICE = 1 << 24


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count + 1, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first words, hash, other hash, first word of each text)`` of all windows inside texts."""
    starts, ends, firsts = spans(data, offsets, "space")
    counts = np.maximum(np.diff(firsts) - size + 1, 0)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(firsts[:-1], counts)
    hashes = []
    base = 0xD1342543DE82EF95
    scale = _powers(pow(base, -1, 2**64), len(starts))[at]
    powers = _powers(base, len(starts))[:-1]
    with np.errstate(over="ignore"):
        for seed in (1, 2):
            sums = np.zeros(len(starts) + 1, np.uint64)
            np.cumsum(hash_words(data, starts, ends, seed) * powers, out=sums[1:])
            hashes.append(mixed((sums[at + size] - sums[at]) * scale) if len(at) else np.zeros(0, np.uint64))
    return at, hashes[0], hashes[1], firsts


def _slots(first: np.ndarray, second: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return first % np.uint64(width), second % np.uint64(width) + np.uint64(width)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values, and for each value which of them it is."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], number


def _sliced(keys: np.ndarray, slices: int, width: int) -> Iterator[tuple[int, int, int]]:
    """``(slice, from, to)`` of the nonempty slices of sorted keys."""
    points = [0, *B.cut_points(keys, slices, width).tolist(), len(keys)]
    for k, (a, b) in enumerate(zip(points, points[1:])):
        if a < b:
            yield k, a, b


def _ask_sketch(size: int, width: int, slices: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, first, second, _ = windows(*B.texts_of(batch, k), size)
                slots, counts = np.unique(np.concatenate(_slots(first, second, width)), return_counts=True)
                rows = [
                    (s, batch.column("block")[k].as_py(), B.pack_sorted(slots[a:b]), B.pack_bits(counts[a:b] > 1))
                    for s, a, b in _sliced(slots, slices, -(-2 * width // slices))
                ]
                if rows:
                    yield _batch(rows, ["slice", "block", "keys", "twice"])

    return ask


_KINDS = {"slice": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "others": pa.binary(), "twice": pa.binary(), "answer": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*rows))], names=names)


def _merge_sketch(width: int, slices: int):
    held = -(-2 * width // slices)

    def merge(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        counters = np.zeros(held, np.uint8)
        keys = []
        for packed, twice in zip(table.column("keys").to_pylist(), table.column("twice").to_pylist()):
            slots = B.unpack_sorted(packed) - np.uint64(number * held)
            # A block has each slot once, and no counter passes 2.
            counters[slots] = np.minimum(counters[slots] + 1 + B.unpack_bits(twice, len(slots)), 2)
            keys.append(packed)
        answers = [B.pack_bits(counters[B.unpack_sorted(packed) - np.uint64(number * held)] > 1) for packed in keys]
        return pa.table(
            {"block": table.column("block"), "slice": table.column("slice"), "answer": pa.array(answers, pa.binary())}
        )

    return merge


def _candidates(batch: pa.RecordBatch, k: int, size: int, width: int, slices: int) -> tuple:
    """Windows of a block that both rows of the merged sketch count twice: sorted distinct hashes and counts."""
    data, offsets = B.texts_of(batch, k)
    at, first, second, firsts = windows(data, offsets, size)
    places = _slots(first, second, width)
    slots, slot_of = _numbered(np.concatenate(places))
    held = -(-2 * width // slices)
    flags = [
        B.unpack_bits(answer, b - a)
        for answer, (_, a, b) in zip(B.answers_of(batch, "sketched", k), _sliced(slots, slices, held))
    ]
    flags = np.concatenate(flags) if flags else np.zeros(0, bool)
    # A slot counted once stands for a window that starts nowhere else.
    kept = flags[slot_of[: len(at)]] & flags[slot_of[len(at) :]] if len(at) else flags
    at, first, second = at[kept], first[kept], second[kept] >> np.uint64(32)
    order = np.lexsort((second, first))
    first, second, at = first[order], second[order], at[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    number = np.cumsum(new) - 1
    return data, offsets, firsts, at, number, first[new], second[new], np.bincount(number, minlength=int(new.sum()))


def _exact_slices(slices: int) -> int:
    return -(-(2**64) // slices)


def _ask_exact(size: int, width: int, slices: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                *_, first, second, counts = _candidates(batch, k, size, width, slices)
                rows = [
                    (
                        s,
                        batch.column("block")[k].as_py(),
                        B.pack_sorted(first[a:b]),
                        B.pack(second[a:b].astype(np.uint32)),
                        B.pack_bits(counts[a:b] > 1),
                    )
                    for s, a, b in _sliced(first, slices, _exact_slices(slices))
                ]
                if rows:
                    yield _batch(rows, ["slice", "block", "keys", "others", "twice"])

    return ask


def _group_exactly(table: pa.Table) -> pa.Table:
    first = [B.unpack_sorted(x) for x in table.column("keys").to_pylist()]
    second = [B.unpack(x) for x in table.column("others").to_pylist()]
    counts = [1 + B.unpack_bits(x, len(f)) for x, f in zip(table.column("twice").to_pylist(), first)]
    ends = np.cumsum([len(f) for f in first])
    first, second, counts = (np.concatenate(x) for x in (first, second, counts))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    number = np.cumsum(new) - 1
    repeated = np.empty(len(first), bool)
    repeated[order] = (np.bincount(number, weights=counts[order]) > 1)[number]
    answers = [B.pack_bits(flags) for flags in np.split(repeated, ends[:-1])]
    return pa.table({"block": table.column("block"), "slice": table.column("slice"), "answer": pa.array(answers, pa.binary())})


def _remove(size: int, width: int, slices: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, offsets, firsts, at, number, first, _, counts = _candidates(batch, k, size, width, slices)
                flags = [
                    B.unpack_bits(answer, b - a)
                    for answer, (_, a, b) in zip(
                        B.answers_of(batch, "grouped", k), _sliced(first, slices, _exact_slices(slices))
                    )
                ]
                flags = np.concatenate(flags) if flags else np.zeros(0, bool)
                begun = at[flags[number]] if len(at) else at
                cover = np.zeros(firsts[-1] + 1, np.int64)
                np.add.at(cover, begun, 1)
                np.add.at(cover, begun + size, -1)
                kept = np.cumsum(cover)[:-1] == 0
                texts, removed = [], []
                raw, edges = data.tobytes(), offsets.tolist()
                for a, b, f, t in zip(edges, edges[1:], firsts.tolist(), firsts[1:].tolist()):
                    own = kept[f:t]
                    gone = len(own) - int(own.sum())
                    words = raw[a:b].split()
                    texts.append(b" ".join(compress(words, own.tolist()) if gone else words))
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[k].values,
                        pa.array(np.diff(firsts), pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array([t.decode() for t in texts], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return remove


def count_windows(blocks: DataFrame, size: int) -> int:
    """Windows of all blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = 0
            for k in range(batch.num_rows):
                words = np.diff(spans(*B.texts_of(batch, k), "space")[2])
                total += int(np.maximum(words - size + 1, 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    return blocks.select("offsets", "text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each document without the words of repeated windows.

    Words are runs of all but ASCII white space, compared as they are; ``kept`` has
    the words that stay, one space between them.  Every occurrence of a repeated
    window goes, the first too; windows are judged on the input alone.

    Null and empty texts have no words and keep an empty text; a repeated row
    repeats its windows; null and equal ids stay rows of their own; a text of any
    length is one block at most; an empty table gives no rows; other columns are
    not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    blocks = B.write_blocks(rows, "text", ["id"], block_bytes)
    width = max(64, COUNTERS * count_windows(blocks, window))
    slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * width // SLICE))
    asked = blocks.mapInArrow(_ask_sketch(window, width, slices), "slice int, block long, keys binary, twice binary")
    reply = "block long, slice int, answer binary"
    sketched = B.answered(blocks, cut(asked.groupBy("slice").applyInArrow(_merge_sketch(width, slices), reply)), "sketched")
    asked = sketched.mapInArrow(
        _ask_exact(window, width, slices), "slice int, block long, keys binary, others binary, twice binary"
    )
    grouped = B.answered(sketched, cut(asked.groupBy("slice").applyInArrow(_group_exactly, reply)), "grouped")
    kind = docs.schema[doc_id].dataType.simpleString()
    return grouped.mapInArrow(
        _remove(window, width, slices), f"doc_id {kind}, n_words long, n_removed long, kept string"
    )

