"""Documents packed into sequences of equal length, without two of a source or of a group of copies together.

A document longer than a bin fills bins of its own; what is left of it, or a
shorter document, is a piece.  Pieces are dealt into shards of a bounded number
and each shard is packed alone, longest piece first, into the tightest bin that
fits and bears it.  Bins stand in order of residual space and carry bitmaps of
their sources and their groups of copies; the search starts at the first bin
with room and goes on until one shares neither.

Shards do not grow with the data, so neither does the work per piece; a shard
leaves a few half-filled bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import cut

CAPACITY = 2048
#: Pieces of a shard, about.
SHARD_PIECES = 2000


def best_fit(sizes: list[int], sources: list, groups: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the given order.

    A piece goes to the compatible bin with the least residual that fits, of equal
    ones to the oldest; else to a new bin.  ``None`` as source or group never
    conflicts.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    group_bit = {g: 1 << i for i, g in enumerate(dict.fromkeys(g for g in groups if g is not None))}
    order: list[tuple[int, int]] = []  # (residual, bin) of bins with room
    held_sources: list[int] = []
    held_groups: list[int] = []
    bins, offsets = [], []
    for size, source, group in zip(sizes, sources, groups):
        s, g = source_bit.get(source, 0), group_bit.get(group, 0)
        place = bisect_left(order, (size, -1))
        while place < len(order) and (held_sources[order[place][1]] & s or held_groups[order[place][1]] & g):
            place += 1
        if place < len(order):
            residual, chosen = order.pop(place)
        else:
            residual, chosen = capacity, len(held_sources)
            held_sources.append(0)
            held_groups.append(0)
        held_sources[chosen] |= s
        held_groups[chosen] |= g
        bins.append(chosen)
        offsets.append(capacity - residual)
        if residual > size:
            insort(order, (residual - size, chosen))
    return bins, offsets


def word_count(text: str) -> Column:
    """Words of a text, runs of all but ASCII white space, and one end mark; a null text has the mark only."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long") + 1


def copies_group(text: str) -> Column:
    """Equal for texts that differ in letter case and outer space only; null for null."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.lower(F.trim(F.col(text)))))


def pack(
    docs: DataFrame,
    size: Column | None = None,
    group: Column | None = None,
    source: Column | None = None,
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, bin_id, bin_offset)``, a row for each piece of each document.

    ``size`` counts a document's tokens (:func:`word_count` of ``text``), ``group``
    names its group of copies (:func:`copies_group`) and ``source`` its source (the
    column ``source``); a bin never has two pieces of one source or one group.
    Pieces that fill a bin are alone in it.

    Null ids are kept; null sources and groups never conflict; an empty document
    has one piece, its end mark; repeated rows are packed each; of equal sizes the
    smaller id comes first; an empty table gives no rows; further columns are not
    read.
    """
    size = word_count("text") if size is None else size
    group = copies_group("text") if group is None else group
    source = F.col("source") if source is None else source
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), size.alias("size"), group.alias("own_group"), source.alias("own_source")
    ).withColumn("row", F.monotonically_increasing_id())
    # Written, so that the row numbers stay what they are.
    rows = cut(rows.where("size > 0"))
    last = F.floor((F.col("size") - 1) / capacity).cast("long")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    total = rows.agg(F.sum(F.ceil(F.col("size") / capacity))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    pieces = pieces.select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
        "doc_id",
        "row",
        "piece",
        (F.col("piece") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("long").alias("n_tokens"),
        "own_group",
        "own_source",
    )

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "row"))])
        bins, offsets = best_fit(
            table.column("n_tokens").to_pylist(),
            table.column("own_source").to_pylist(),
            table.column("own_group").to_pylist(),
            capacity,
        )
        shard = table.column("shard")[0].as_py()
        numbers = np.array(bins, np.int64) + (shard << 32)
        out = table.select(["doc_id", "piece", "first_token", "n_tokens"])
        return out.append_column("bin_id", pa.array(numbers)).append_column("bin_offset", pa.array(offsets, pa.int64()))

    key = docs.schema[doc_id].dataType.simpleString()
    return pieces.groupBy("shard").applyInArrow(
        pack_shard, f"doc_id {key}, piece long, first_token long, n_tokens long, bin_id long, bin_offset long"
    )
