"""Near-duplicate documents by SimHash, compared exactly tile against tile.

Distinct fingerprints are dealt into tiles of similar population count.  Two
fingerprints within the radius differ in population count by no more than the
radius, so tile pairs further apart are skipped; the others are compared with
exclusive-or and bit counts.  A tile pair returns its links as a forest, so a
dense group costs its size and not its pairs.  Copies share a fingerprint and
meet no tile twice.

The comparison is exact, hence quadratic in the number of distinct
fingerprints; tiles bound its memory and its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import components, local_components
from tidemark.llm.rows import appended, fresh, schema_with, steps, text_buffer
from tidemark.llm.words import lower_table
from tidemark.plans.durable import cut

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints in a tile.
TILE = 32768
#: Rows of a tile compared with the other tile at a time.
_ROWS = 32
#: Links that a tile pair keeps before it reduces them to a forest.
_LINKS = 1 << 20


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64.  No words: 0."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        to = min(last, at + (1 << 16))
        begin, end = starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view(np.uint64)[0])


def add_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> tuple[DataFrame, str]:
    """``docs`` with the fingerprint of each whole text as a long, and that column's name.

    A-Z are lower-cased; words are runs of all but ASCII white space.  Null: no words.
    """
    name = fresh(docs, "fingerprint")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            raw, edges = lower_table()[data].tobytes(), offsets.tolist()
            prints = [fingerprint(raw[a:b].split(), shingle) for a, b in zip(edges, edges[1:])]
            yield appended(batch, **{name: pa.array(np.array(prints, np.uint64).view(np.int64))})

    return docs.mapInArrow(add, schema_with(docs, (name, T.LongType()))), name


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Rows ``(a, b)`` that connect what links between two tiles connect; ``left is right`` for one tile."""
    same = left is right
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = left if same else right[np.argsort(np.bitwise_count(right), kind="stable")]
    count, other = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    shift = 0 if same else len(left)
    kept: list[np.ndarray] = []
    held = 0

    def forest() -> np.ndarray:
        if not kept:
            return np.zeros((2, 0), np.int64)
        pairs = np.concatenate(kept, axis=1)
        label = local_components(shift + len(right), pairs[0], pairs[1])
        nodes = np.flatnonzero(label != np.arange(len(label)))
        return np.stack([nodes, label[nodes]])

    for at in range(0, len(left), _ROWS):
        rows = left[at : at + _ROWS]
        first = np.searchsorted(other, count[at] - radius)
        last = np.searchsorted(other, count[min(at + _ROWS, len(left)) - 1] + radius, side="right")
        first = max(first, at) if same else first
        if first >= last:
            continue
        near = np.bitwise_count(rows[:, None] ^ right[None, first:last]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + first
        if same:
            later = i < j
            i, j = i[later], j[later]
        if len(i):
            kept.append(np.stack([i, j + shift]))
            held += len(i)
        if held > _LINKS:
            kept = [forest()]
            held = kept[0].shape[1]
    nodes = left if same else np.concatenate([left, right])
    return nodes[forest()].T


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(a, b)`` of a forest with the components of all links within ``radius`` bits.

    ``prints`` has one column ``fp`` of distinct longs.
    """
    spark = prints.sparkSession
    prints = prints.withColumn("_ones", F.bit_count("fp"))
    # At most 65 rows: how many fingerprints have each population count.
    sizes = {r["_ones"]: r["n"] for r in prints.groupBy("_ones").agg(F.count(F.lit(1)).alias("n")).collect()}
    bands: list[list[int]] = []  # lowest, highest population count and size
    band_of = [0] * 65
    for ones in sorted(sizes):
        if bands and bands[-1][2] + sizes[ones] <= tile:
            bands[-1][1:] = [ones, bands[-1][2] + sizes[ones]]
        else:
            bands.append([ones, ones, sizes[ones]])
        band_of[ones] = len(bands) - 1
    # For each band: its tiles, and the last band within the radius.
    parts_of = [-(-size // tile) for _, _, size in bands] or [1]
    last_of = [max(k for k, (low, _, _) in enumerate(bands) if low - high <= radius) for _, high, _ in bands] or [0]
    look_up = lambda table, index: F.element_at(F.array(*map(F.lit, table)), F.col(index) + 1)
    tiles = cut(
        prints.withColumn("band", look_up(band_of, "_ones"))
        .withColumn("part", F.pmod(F.xxhash64("fp"), look_up(parts_of, "band")).cast("int"))
        .groupBy("band", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    pairs = (
        tiles.select("band", "part", F.explode(F.sequence("band", look_up(last_of, "band"))).alias("band2"))
        .withColumn("first", F.when(F.col("band2") == F.col("band"), F.col("part")).otherwise(0))
        .withColumn("part2", F.explode(F.sequence("first", look_up(parts_of, "band2") - 1)))
        .select("band", "part", "band2", "part2")
    )
    right = tiles.select(F.col("band").alias("band2"), F.col("part").alias("part2"), F.col("fps").alias("fps2"))
    one = (F.col("band") == F.col("band2")) & (F.col("part") == F.col("part2"))
    work = (
        pairs.join(tiles.select("band", "part", "fps"), ["band", "part"])
        .join(right, ["band2", "part2"])
        .select("fps", F.when(one, F.array().cast("array<long>")).otherwise(F.col("fps2")).alias("fps2"), one.alias("one"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, other = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
                found = tile_links(left, left if batch.column(2)[k].as_py() else other, radius).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return work.mapInArrow(compare, "a long, b long")


def components_of(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(fp, root)`` for each fingerprint; ``prints`` has the distinct ``fp``."""
    roots = components(links(prints, radius, tile)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return prints.select("fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id among the
    documents reachable over links of at most ``radius`` differing bits.

    Null and empty texts have fingerprint 0 and link like any other; a null id is
    never the smallest unless all of a component are null; equal rows give equal
    rows; an empty table gives none; other columns of ``docs`` are not read.
    """
    added, name = add_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", shingle)
    rows = cut(added.select("doc_id", F.col(name).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components_of(prints, radius, tile).join(prints, "fp"))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = roots.join(smallest, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE
) -> DataFrame:
    """One row of each component of :func:`near_duplicates`: the smallest id, any one of equal ids; columns unchanged."""
    added, name = add_fingerprint(docs, text, shingle)
    key = fresh(added, "row")
    rows = cut(added.withColumn(key, F.monotonically_increasing_id()))
    narrow = rows.select(F.col(f"`{name}`").alias("fp"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{key}`").alias("key"))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key")))  # of equal fingerprints, then of a component
    prints = cut(narrow.groupBy("fp").agg(first.alias("first")))
    roots = components_of(prints, radius, tile).join(prints, "fp")
    kept = cut(roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key)))
    # Kept rows grow with the table: merged at every size, never broadcast.
    return rows.join(kept.hint("merge"), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
