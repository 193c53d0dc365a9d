"""Near copies by the Jaccard similarity of their word shingles; every link is found and checked exactly.

Texts with the same set of shingles are one node.  First SimHash: fingerprints over the same shingles are linked
at :data:`simhash.RADIUS` differing bits or fewer, and each such link is decided on the shingles themselves.  Three bits
find the closest copies only, so the rest are found by their rarest shingles.  Shingles are ordered from rare to frequent by
counts over all texts: counters in slices of a sketch, which may count too many but give a shingle
the same rank everywhere.  Two sets of ``n`` shingles and more can only be ``s`` similar if they share one of
their ``n - ceil(s * n) + 1`` first shingles in that order, so a node has those as keys and only nodes
with a common key are compared.  A frequent passage or line stands last and makes no key, unless
a text is little else; a shingle that was counted once makes none either.

Each node first meets one leader, the neighbour whose own keys are the most frequent: in a group of edited
copies that is the text they were made from.  Nodes near one leader are then told apart by how they differ from it: of two
sets the difference is the difference of their differences, so what all of a group have in common drops out, and
the same prefix rule holds for the shingles in which they differ.  There again they meet one leader of each key
first.  What is connected is not compared again; afterwards the nodes of a key that are in different components meet,
where sizes and the shingles that others share at all allow the similarity: nodes of one leader by their differences,
others by their own keys.  So a group of near copies costs its size, whether its texts link to one another, to
some or to none, and nothing that could link stays uncompared unless it is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import blocks as B
from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.rows import appended, fresh, schema_with, steps, text_buffer
from tidemark.llm.words import ODD, distinct, hash_words, lower_table, mixed, spans
from tidemark.plans.durable import cut
from tidemark.plans.spread import spread_join

SHINGLE = 5
SIMILARITY = 0.8
#: Counters of the sketch for each shingle, and of a slice at most.
COUNTERS = 8
SLICE = 1 << 24
#: Text of a block, and text that is fingerprinted at a time.
BLOCK_BYTES, STEP_BYTES = 4 << 20, 1 << 20
#: A node goes by its difference from a leader of this similarity at least; pairs that are compared at a time.
NEAR, PAIRS = 0.5, 256
#: For rounding.
MARGIN = 1e-6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Ascending distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    data = lower_table()[data]
    starts, ends, firsts = spans(data, offsets, "space")
    words = hash_words(data, starts, ends)

    def chained(words: np.ndarray, length: int) -> np.ndarray:
        grams = words
        for k in range(1, length):
            with np.errstate(over="ignore"):
                grams = mixed(grams[:-1] * ODD + words[k:])
        return grams

    whole = chained(words, shingle) if len(words) >= shingle else words[:0]
    edges = firsts.tolist()
    for a, b in zip(edges, edges[1:]):
        yield distinct(whole[a : b - shingle + 1] if b - a >= shingle else chained(words[a:b], b - a))


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; of two empty ones 1."""
    either = len(distinct(np.concatenate([left, right])))
    return (len(left) + len(right) - either) / either if either else 1.0


def _sliced(slots: np.ndarray, slices: int, width: int) -> Iterator[tuple[int, int, int]]:
    """``(slice, from, to)`` of the nonempty slices of sorted slots."""
    points = [0, *B.cut_points(slots, slices, width).tolist(), len(slots)]
    for k, (a, b) in enumerate(zip(points, points[1:])):
        if a < b:
            yield k, a, b


def _sets_of(batch: pa.RecordBatch, k: int, shingle: int) -> list[tuple[int, np.ndarray]]:
    """``(row, shingles)`` of the texts of a block that stand for their set."""
    rows = batch.column("row")[k].as_py()
    sets = shingle_sets(*B.texts_of(batch, k), shingle)
    chosen = set(batch.column("chosen")[k].as_py() or [])
    return [(row, grams) for row, grams in zip(rows, sets) if row in chosen and len(grams)]


def _slots(sets: list[tuple[int, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct slots of a block and how many of its shingles fall into each."""
    flat = np.concatenate([g for _, g in sets]) if sets else np.zeros(0, np.uint64)
    return np.unique(flat % np.uint64(width), return_counts=True)


def levels_of(blocks: DataFrame, width: int, slices: int, shingle: int) -> DataFrame:
    """``(block, slice, answer)``: of each slot that a block asked about the logarithm of its count over all blocks."""
    held = -(-width // slices)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                slots, counts = _slots(_sets_of(batch, k, shingle), width)
                number = batch.column("block")[k].as_py()
                rows = [(s, number, B.pack_sorted(slots[a:b]), B.pack(counts[a:b].astype(np.uint32))) for s, a, b in _sliced(slots, slices, held)]
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["slice", "block", "slots", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        low = np.uint64(table.column("slice")[0].as_py() * held)
        counters = np.zeros(held, np.uint32)
        asked = table.column("slots").to_pylist()
        for packed, counts in zip(asked, table.column("counts").to_pylist()):
            counters[B.unpack_sorted(packed) - low] += B.unpack(counts)  # a block has each slot once
        level = np.zeros(held, np.uint8)
        some = counters > 0
        level[some] = np.log2(counters[some]).astype(np.uint8)
        answers = [B.pack(level[B.unpack_sorted(packed) - low]) for packed in asked]
        return pa.table({"block": table.column("block"), "slice": table.column("slice"), "answer": pa.array(answers, pa.binary())})

    asked = blocks.mapInArrow(ask, "slice int, block long, slots binary, counts binary")
    return asked.groupBy("slice").applyInArrow(merge, "block long, slice int, answer binary")


def first_shingles(grams: np.ndarray, levels: np.ndarray, least: float) -> tuple[np.ndarray, int, int]:
    """``(keys, shared, mass)``: the first shingles from rare to frequent that others may have, how many of
    the set others may have, and the mean level of the first ones in 64ths.

    No key for a set that has too many shingles of its own to be similar to another.
    """
    size = len(grams)
    shared = int((levels > 0).sum())
    length = size - int(np.ceil(least * size - MARGIN)) + 1
    if shared < least * size - MARGIN:
        return grams[:0], shared, 0
    order = np.lexsort((grams, levels))[:length]
    return grams[order][levels[order] > 0], shared, int(levels[order].sum() * 64 // length)


def _keys(blocks: DataFrame, width: int, slices: int, least: float, shingle: int) -> DataFrame:
    """``(node, size, shared, mass, key)`` of all nodes, from blocks with their levels."""
    held = -(-width // slices)
    fields = ["node", "size", "shared", "mass"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sets = _sets_of(batch, k, shingle)
                slots, _ = _slots(sets, width)
                parts = [B.unpack(answer) for answer in B.answers_of(batch, "levels", k)]
                known = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
                rows, keys = [], []
                for row, grams in sets:
                    found, shared, mass = first_shingles(grams, known[np.searchsorted(slots, grams % np.uint64(width))], least)
                    rows.append((row, len(grams), shared, mass, len(found)))
                    keys.append(found.view(np.int64))
                if keys:
                    *columns, counts = (np.array(c, np.int64) for c in zip(*rows))
                    arrays = [pa.array(np.repeat(c, counts)) for c in columns]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(keys))], names=[*fields, "key"])

    return blocks.mapInArrow(run, ", ".join(f"{n} long" for n in (*fields, "key")))


def _compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(a, b, size, linked, apart)`` of ``(a, b)``: size of the set of ``a``, whether the two are ``least`` similar or
    more, and the shingles that only one of them has (null if they are less than :data:`NEAR` similar)."""
    left, right = (sets.select(F.col("node").alias(n), F.col("grams").alias(f"grams_{n}")) for n in "ab")
    work = spread_join(pairs, right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "grams_a", "grams_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(start, PAIRS)
                sizes, linked, apart = [], [], []
                for k in range(batch.num_rows):
                    one, other = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                    alike = similarity(one, other)
                    sizes.append(len(one))
                    linked.append(alike >= least)
                    apart.append(np.setxor1d(one, other, assume_unique=True).view(np.int64) if alike >= NEAR else None)
                columns = [pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), pa.array(apart, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["a", "b", "size", "linked", "apart"])

    return work.mapInArrow(compare, "a long, b long, size long, linked boolean, apart array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets are ``least`` similar or more."""
    return _compared(pairs, sets, least).where("linked").select("a", "b")


def _able(size: Column, shared: Column, size_2: Column, shared_2: Column, least: float) -> Column:
    """Whether two sets can be as similar: what both have is no more than what either shares with others at all."""
    both = F.least(shared, shared_2)
    return both * (1 + least) >= (size + size_2) * least - MARGIN


def _pairs(of: DataFrame, one: Column, other: Column) -> DataFrame:
    """Distinct ``(a, b)``, smaller first."""
    return of.where(one != other).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the root of each node, itself where it is connected to nothing smaller."""
    roots = roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with the largest one as ``main``."""
    parts = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "root"))["root"].alias("main")
    open_ = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), largest).where("parts > 1").drop("parts")
    return cut(members.join(open_.hint("merge"), "bucket"))


def _across(members: DataFrame, condition: Column, names: tuple[str, ...]) -> DataFrame:
    """``(a, b)`` of a bucket in different components that fulfil a condition; the other's columns end in ``_2``."""
    others = members.where("root != main").select("bucket", *[F.col(c).alias(f"{c}_2") for c in ("node", "root", *names)])
    apart = F.expr("root != root_2 AND (root = main OR node < node_2)")
    met = members.hint("merge").join(others, (members["bucket"] == others["bucket"]) & apart & condition)
    return _pairs(met, F.col("node"), F.col("node_2"))


def _by_difference(compared: DataFrame, least: float) -> DataFrame:
    """``(node, size, apart, shared, bucket)``: nodes of one leader under the rarest shingles in which they differ from it.

    Two sets are ``least`` similar if they differ in at most ``room`` shingles.  Then their differences from
    the leader share all but ``room`` of the larger one, so one of its first ``room + 1`` shingles; or both are
    so small that they need not share any, which is a key of its own.
    """
    room = F.floor(F.col("size") * (1 + 1 / least) * (1 - least) / (1 + least) + MARGIN).cast("int")
    tokens = compared.select(F.col("b").alias("leader"), F.col("a").alias("node"), "size", F.explode("apart").alias("token"))
    counts = tokens.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("n"))
    counted = tokens.join(counts.hint("merge"), ["leader", "token"]).groupBy("leader", "node", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens")
    )
    keys = F.transform(
        F.filter(F.slice("tokens", 1, room + 1), lambda x: x["n"] > 1), lambda x: F.xxhash64(F.col("leader"), x["token"])
    )
    none = F.when(F.size("tokens") <= room, F.array(F.xxhash64(F.col("leader")))).otherwise(F.array().cast("array<long>"))
    return counted.select(
        "node",
        "size",
        F.size("tokens").cast("long").alias("apart"),
        F.size(F.filter("tokens", lambda x: x["n"] > 1)).cast("long").alias("shared"),
        F.explode(F.concat(keys, none)).alias("bucket"),
    )


def _able_apart(least: float, other: str = "") -> Column:
    """Whether two nodes of one leader can be as similar, by what they differ in from it and share with others."""
    c = lambda n: F.col(f"{other}{n}" if other else f"{n}_2")
    room = (F.col("size") + c("size")) * (1 - least) / (1 + least) + MARGIN
    return F.least(F.col("shared"), c("shared")) * 2 >= F.col("apart") + c("apart") - room


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: nodes with their smallest of the same fingerprint, and those of linked fingerprints; to be decided exactly.

    ``nodes`` has ``node`` and ``print``.
    """
    prints = cut(nodes.groupBy("print").agg(F.min("node").alias("first")))
    equal = nodes.join(prints.hint("merge"), "print").select("node", "first")
    ends = [prints.select(F.col("print").alias(c), F.col("first").alias(f"node_{c}")) for c in "ab"]
    forest = simhash.links(prints.select(F.col("print").alias("fp")))
    linked = forest.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select("node_a", "node_b")
    return _pairs(equal.union(linked), F.col("node"), F.col("first"))


def _links(blocks: DataFrame, width: int, slices: int, least: float, shingle: int, alike: DataFrame) -> DataFrame:
    """``(a, b)`` whose components are those of all links between nodes; ``alike`` has the pairs by SimHash."""
    levelled = B.answered(blocks, cut(levels_of(blocks, width, slices, shingle)), "levels")
    keys = _keys(levelled, width, slices, least, shingle)
    # Similar sets differ by one class of size at most: a set stands under its class and the next.
    class_ = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / least)) + MARGIN)
    buckets = keys.select("node", "size", "shared", "mass", F.explode(F.array(class_, class_ + 1)).alias("class"), "key")
    buckets = buckets.select("node", "size", "shared", "mass", F.xxhash64("key", "class").alias("bucket"))
    leader = F.max(F.struct("mass", F.xxhash64("node").alias("order"), "node", "size", "shared"))
    led = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), leader.alias("leader")).where("n > 1").drop("n")
    members = cut(buckets.join(led.hint("merge"), "bucket"))

    # One leader a node, above it in the order of leaders.
    able = _able(F.col("size"), F.col("shared"), F.col("leader.size"), F.col("leader.shared"), least)
    own = F.struct("mass", F.xxhash64("node").alias("order"), "node", "size", "shared")
    best = members.where((F.col("leader") > own) & able).groupBy("node").agg(F.max("leader")["node"].alias("lead"))
    best = cut(best)
    # Only the sets that meet another are made; they lie in buckets, so that comparing moves pairs and a leader's set with each.
    wanted = blocks.select("block", F.explode("chosen").alias("node")).join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    wanted = cut(wanted.groupBy("block").agg(F.collect_list("node").alias("chosen")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = _sets_of(batch, k, shingle)
                if found:
                    nodes, sets = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], names=["node", "grams"])

    sets = blocks.drop("chosen").join(wanted, "block").mapInArrow(gather, "node long, grams binary")
    # Dealt first: otherwise each task writes a file into each bucket.
    buckets = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = B.bucketed(sets.repartition(buckets, "node"), "node", "sets")
    compared = cut(_compared(best.select(F.col("node").alias("a"), F.col("lead").alias("b")), sets, least))
    # Pairs by SimHash that link have a key in common, so their sets are there.
    by_print = _linked(alike, sets, least)
    stars = cut(components(compared.where("linked").select("a", "b").unionByName(by_print)))

    # Nodes of one leader, by what they differ in.
    near = compared.where("apart IS NOT NULL")
    best = near.select(F.col("a").alias("node"), F.col("b").alias("lead"))
    apart = cut(_rooted(_by_difference(near, least), stars))
    first = F.min(F.struct("apart", F.xxhash64("node").alias("order"), "node", "size", "shared", "root")).alias("first")
    nearest = apart.join(apart.groupBy("bucket").agg(first).hint("merge"), "bucket")
    nearest = nearest.where((F.col("root") != F.col("first.root")) & _able_apart(least, "first."))
    more = _linked(cut(_pairs(nearest, F.col("node"), F.col("first.node"))), sets, least)
    stars = cut(components(stars.unionByName(more)))
    apart = _open(_rooted(apart.drop("root"), stars))
    rest = _across(apart, _able_apart(least), ("size", "apart", "shared"))

    # Nodes of different leaders, by their own keys.
    members = members.drop("leader", "mass").join(best.hint("merge"), "node", "left").withColumn("lead", F.coalesce("lead", "node"))
    members = _open(_rooted(members, stars))
    able = _able(*[F.col(c) for c in ("size", "shared", "size_2", "shared_2")], least)
    other = _across(members, able & (F.col("lead") != F.col("lead_2")), ("size", "shared", "lead"))
    met = cut(rest.unionByName(other).distinct())
    return stars.unionByName(_linked(met, sets, least))


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE
) -> DataFrame:
    """One row of each group of near copies: the smallest id, any one of equal ids; columns unchanged.

    Two texts link if their sets of ``shingle`` consecutive words have a Jaccard
    similarity of ``least`` or more; groups are what links connect.  A-Z are
    lower-cased; words are runs of all but ASCII white space; a text of fewer than
    ``shingle`` words is one shingle.  Links come from SimHash and from rare shingles and are all decided exactly.

    Null, empty and blank texts are copies of one another; a null id is kept only
    where all of a group are null; an empty table gives none.
    """
    names = [fresh(docs, n) for n in ("near_set", "near_size", "near_print")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, STEP_BYTES):
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            raw, edges = lower_table()[data].tobytes(), offsets.tolist()
            prints = np.array([simhash.fingerprint(raw[a:b].split(), shingle) for a, b in zip(edges, edges[1:])], np.uint64)
            sets, sizes = [], []
            for grams in shingle_sets(data, offsets, shingle):
                sets.append(xxhash.xxh3_128_digest(grams.tobytes()))
                sizes.append(len(grams))
            columns = (pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints.view(np.int64)))
            yield appended(batch, **dict(zip(names, columns)))

    added = docs.mapInArrow(add, schema_with(docs, *zip(names, (T.BinaryType(), T.LongType(), T.LongType()))))
    key = fresh(added, "row")
    rows = cut(added.withColumn(key, F.monotonically_increasing_id()))
    narrow = rows.select(*[F.col(f"`{n}`").alias(c) for n, c in zip((*names, doc_id, key), ("set", "size", "print", "id", "key"))])
    # Of equal sets, then of a component.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "print")).alias("first")
    nodes = cut(narrow.groupBy("set").agg(first, F.max("size").alias("size")).withColumn("node", F.col("first.key")))
    shingles = nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    width = max(64, COUNTERS * shingles)
    slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-width // SLICE))

    texts = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("row"))
    blocks = B.write_blocks(texts, "text", ["row"], BLOCK_BYTES)
    # The rows of a block that stand for their set; the texts stay where they are.
    places = blocks.select("block", F.explode("row").alias("row"))
    chosen = places.join(nodes.where("size > 0").select(F.col("node").alias("row")).hint("merge"), "row")
    chosen = cut(chosen.groupBy("block").agg(F.collect_list("row").alias("chosen")))
    blocks = blocks.join(chosen, "block")

    alike = cut(simhash_pairs(nodes.where("size > 0").select("node", F.col("first.print").alias("print"))))
    roots = components(_links(blocks, width, slices, least, shingle, alike)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = nodes.select("node", "first").join(roots.hint("merge"), "node", "left")
    kept = labels.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    # Kept rows grow with the table: merged at every size, never broadcast.
    kept = cut(kept.select(F.col("first.key").alias(key)))
    return rows.join(kept.hint("merge"), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
