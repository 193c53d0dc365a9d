"""Ranked search of documents for the terms of given items, by dense matrix products that are exact.

Items are taken in blocks.  A block's vocabulary goes to all tasks, the documents shrink to counts of
its terms, and the corpus statistics come from those counts.  Scores are products of two integer
matrices: term weights of the items, tile by tile of the vocabulary, times term impacts of a tile of
documents.  Each product runs in float64 by BLAS; a tile's weights are bounded so that no partial sum
reaches 2**53, so every sum is exact in any order, and tiles are added as 64-bit integers.  A tile
keeps every document that ties with its last place; ids decide later, so ties are safe.

Documents never move: a task sends at most ``k`` rows an item to the final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.rows import steps, text_buffer
from tidemark.llm.words import hash_text_words, hash_words, lower_table, spans
from tidemark.plans.durable import cut
from tidemark.plans.topn import salt_of, top_n_per_group

K = 10
#: Items times distinct terms of a block, at most; only a single item may have more terms.
BLOCK_CELLS = 1 << 23
#: Terms and documents of a tile.
TERM_TILE, DOC_TILE = 2048, 1024
#: An impact is below this: ``10**9 tf div (1000 tf + 8 m)`` with a positive ``m``.
IMPACT_LIMIT = 10**6
#: What the weights of an item in one product may sum to.
WEIGHT_LIMIT = (2**53 - 1) // IMPACT_LIMIT


class Items:
    """Some items: their names, sorted term hashes, and how often each item holds each term."""

    def __init__(self, names: pa.Array, texts: list[np.ndarray]):
        self.names = names
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        self.vocabulary = np.unique(flat)
        term = np.searchsorted(self.vocabulary, flat)
        cells, self.counts = np.unique(item * max(len(self.vocabulary), 1) + term, return_counts=True)
        self.items, self.terms = np.divmod(cells, max(len(self.vocabulary), 1))


class Weights:
    """The items' term weights as matrices, in layers in which no item's weights pass ``limit``."""

    def __init__(self, items: Items, weight: np.ndarray, limit: int = WEIGHT_LIMIT):
        self.count = len(items.names)
        self.layers: list[list[tuple[np.ndarray, np.ndarray]]] = []
        w = items.counts * weight[items.terms]
        whole = np.zeros(self.count, np.int64)
        np.add.at(whole, items.items, w)
        if whole.max(initial=0) <= limit:
            layers = [(items.terms, items.items, w)]
        else:
            # A weight that passes what is left of an item's layer is parted between layers.
            cells: dict[int, list[tuple[int, int, int]]] = {}
            used = [0] * self.count
            for i, t, left in zip(items.items.tolist(), items.terms.tolist(), w.tolist()):
                while left:
                    part = min(left, limit - used[i] % limit)
                    cells.setdefault(used[i] // limit, []).append((t, i, part))
                    used[i] += part
                    left -= part
            layers = [tuple(np.array(x, np.int64) for x in zip(*cells[layer])) for layer in sorted(cells)]
        for t, i, w in layers:
            tiles = []
            terms = np.unique(t)
            for at in range(0, len(terms), TERM_TILE):
                tile = terms[at : at + TERM_TILE]
                inside = (t >= tile[0]) & (t <= tile[-1])
                matrix = np.zeros((self.count, len(tile)))
                matrix[i[inside], np.searchsorted(tile, t[inside])] = w[inside]
                tiles.append((tile, matrix))
            self.layers.append(tiles)

    def scores(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> np.ndarray:
        """Items by documents; ``impacts`` of the given terms in the given documents."""
        total = np.zeros((self.count, n_docs), np.int64)
        for tiles in self.layers:
            for tile, matrix in tiles:
                place = np.minimum(np.searchsorted(tile, terms), len(tile) - 1)
                inside = tile[place] == terms
                present, row = np.unique(place[inside], return_inverse=True)
                if len(present):
                    dense = np.zeros((len(present), n_docs))
                    dense[row, docs[inside]] = impacts[inside]
                    total += (matrix[:, present] @ dense).astype(np.int64)
        return total


class Best:
    """The ``k`` best documents of each item so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int, items: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: pa.Array | None = None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        least = self.least
        if scores.shape[1] > self.k:
            # What ties with the k-th of the tile stays until the ids decide.
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= least[:, None])
        if not len(item):
            return
        found = ids.take(pa.array(doc))
        self.ids = found if self.ids is None else pa.concat_arrays([self.ids, found])
        self.item, self.score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[item, doc]))
        order = pc.rank(self.ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        by = np.lexsort((order, -self.score, self.item))
        place = np.arange(len(by)) - np.searchsorted(self.item[by], self.item[by])
        kept = by[place < self.k]
        self.item, self.score, self.ids = self.item[kept], self.score[kept], self.ids.take(pa.array(kept))
        last = place[place < self.k] == self.k - 1
        self.least[self.item[last]] = self.score[last]


def blocks_of(items: DataFrame, item_id: str, text: str, cells: int = BLOCK_CELLS) -> Iterator[Items]:
    """The items that have terms, block by block; the driver holds one block at a time."""
    kind = items.select(item_id).schema[0].dataType
    names: list = []
    texts: list[np.ndarray] = []
    seen: set[int] = set()

    def block() -> Items:
        arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
        return Items(pa.array(names, arrow.get(kind)), texts)

    for name, words in items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).toLocalIterator():
        terms = hash_text_words(words, "alnum", lower=True)
        if not len(terms):
            continue
        fresh = set(terms.tolist())
        if names and (len(names) + 1) * len(seen | fresh) > cells:
            yield block()
            names, texts, seen = [], [], set()
        names.append(name)
        texts.append(terms)
        seen |= fresh
    if names:
        yield block()


def term_counts(docs: DataFrame, doc_id: str, text: str, vocabulary) -> DataFrame:
    """``(doc_id, n, terms, tf)`` of the documents with terms: all their terms, and the counts of known ones."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("tf", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in steps(batches, "text"):
            data, offsets = text_buffer(batch.column(1))
            data = lower_table()[data]
            starts, ends, firsts = spans(data, offsets, "alnum")
            hashes = hash_words(data, starts, ends)
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[place] == hashes)
            doc = np.searchsorted(firsts, hit, side="right") - 1
            cells, tf = np.unique(doc * len(known) + place[hit], return_counts=True)
            doc, term = np.divmod(cells, len(known))
            edges = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            sizes = np.diff(firsts)
            lists = (pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (term, tf))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(sizes > 0))

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def length_factor(n: int, documents: int, terms: int) -> int:
    return 100 - 75 + 75 * n * documents // terms


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _best_of_block(counts: DataFrame, block: Items, k: int, item_type: T.DataType) -> DataFrame:
    """``(item, item_id, doc_id, score)``: at most ``k`` rows an item of each task."""
    context = counts.sparkSession.sparkContext
    documents, terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    # One row a term of the block.
    for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():
        df[term] = n
    weights = Weights(block, np.array([term_weight(documents, int(n)) for n in df], np.int64))
    shared = context.broadcast((weights, block.names))
    doc_type = counts.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)]
        + [T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, names = shared.value
        best = Best(k, len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                tile = batch.slice(at, DOC_TILE)
                ids, n, found, tf = (tile.column(c) for c in ("doc_id", "n", "terms", "tf"))
                sizes = pc.list_value_length(found).to_numpy()
                doc = np.repeat(np.arange(tile.num_rows), sizes)
                tf = tf.flatten().to_numpy().astype(np.int64)
                m = np.array([length_factor(x, documents, terms) for x in n.to_pylist()], np.int64)[doc]
                impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                best.add(weights.scores(found.flatten().to_numpy(), doc, impacts, tile.num_rows), ids)
        if best.ids is not None:
            item = pa.array(best.item, pa.int32())
            yield pa.RecordBatch.from_arrays([item, names.take(item), best.ids, pa.array(best.score)], names=schema.names)

    out = cut(counts.mapInArrow(run, schema))
    shared.destroy()
    return out


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` documents of highest score above 0, ties by ascending id.

    Terms are runs of ASCII letters and digits and of all else beyond ASCII, A-Z lower-cased, told
    apart by 64-bit hashes.  With N documents that have terms, L terms in them, n in one document, tf
    of one term there and df documents that hold it, a document's score sums
    ``floor(1000 ln((2N + 2) / (2 df + 1))) * (10**9 tf div (1000 tf + 8 m))`` over the item's terms with
    repeats, where ``m = 25 + 75 n N div L``.

    Null, empty and blank texts have no terms: such documents count nowhere, such items return
    nothing.  Every row of ``items`` is an item of its own and every row of ``docs`` a document, equal
    ids or not; null ids come last among ties.  An empty table gives no rows.

    Each block of items (``block_cells``: items times distinct terms) makes one pass over the documents.
    """
    kind, doc_type = items.select(f"`{item_id}`").schema[0].dataType, docs.select(f"`{doc_id}`").schema[0].dataType
    spark = docs.sparkSession
    found: DataFrame | None = None
    for number, block in enumerate(blocks_of(items, item_id, item_text, block_cells)):
        vocabulary = spark.sparkContext.broadcast(block.vocabulary)
        counts = cut(term_counts(docs, doc_id, text, vocabulary))
        vocabulary.destroy()
        best = _best_of_block(counts, block, k, kind).withColumn("block", F.lit(number))
        found = best if found is None else found.unionByName(best)
    if found is None:
        fields = [("item_id", kind), ("rank", T.IntegerType()), ("doc_id", doc_type), ("score", T.LongType())]
        return spark.createDataFrame([], T.StructType([T.StructField(*f) for f in fields]))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # A task gives k rows an item: salted, since there may be very many tasks.
    ranked = top_n_per_group(found, ["block", "item"], order, k, salt=salt_of("doc_id"), rank_name="rank")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
