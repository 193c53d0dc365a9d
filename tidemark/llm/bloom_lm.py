"""An n-gram language model whose counts lie in one log-frequency Bloom filter.

Counts are gathered from all training documents and quantised to levels that grow
by a fixed factor.  An n-gram of level ``q`` is entered once for each level up to
``q``; a reader probes level after level until one is missing, so it reads the
right level or, by a false positive, a higher one.  The filter has the same number
of bits for each entry at every size (:func:`false_positive_rate`).  Its parts are
broadcast in groups of a bounded size, with a pass over the blocks for each group;
the levels that a pass reads are joined back to the blocks, so texts stay put.

A token's probability mixes the orders from the shortest history on.  How far an
order is trusted depends on the level of the history's count; these weights are
set by deleted interpolation, one more pass over the training documents, in which
every token is left out of the counts that predict it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks as B
from tidemark.llm.words import ODD, hash_words, lower_table, mixed, numbered, spans
from tidemark.plans.durable import cut

ORDER = 3
#: Longer n-grams must occur this often to enter the filter; single words always do.
MIN_COUNT = 2
#: Levels grow by this factor.
BASE = 1.4
BITS_PER_ENTRY, PROBES = 10, 5
#: Bound of what is broadcast at a time.
MAX_FILTER_BYTES = 256 << 20
#: Weights that an order may get, and levels told apart.
GRID = np.array([0, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95])
LEVELS = 128
#: Weight of the orders below the one that is being weighed.
MEANWHILE = 0.3
#: Keys probed at a time, so that what a probe makes of them stays in a core's cache.
STEP_KEYS = 1 << 15
#: Longer n-grams are counted by this many leading bits of their hash.
_COUNTED = np.uint64(0xFFFFFFFFFFFF0000)
END = np.uint64(0x2545F4914F6CDD1D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first of each text)``: the words of each text and one end."""
    data = lower_table()[data]
    starts, ends, firsts = spans(data, offsets, "space")
    texts = len(offsets) - 1
    firsts_out = firsts + np.arange(texts + 1)
    out = np.empty(len(starts) + texts, np.uint64)
    inner = np.ones(len(out), bool)
    inner[firsts_out[1:] - 1] = False
    out[inner] = hash_words(data, starts, ends)
    out[~inner] = END
    return out, firsts_out


def place_of(firsts: np.ndarray) -> np.ndarray:
    """Number of each token in its text, from 0."""
    return np.arange(firsts[-1]) - np.repeat(firsts[:-1], np.diff(firsts))


def gram_keys(words: np.ndarray, firsts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 2: keys at every token, and where a text has that many tokens up to there."""
    place = place_of(firsts)
    out, key = [], words
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            before = np.concatenate((key[:1], key[:-1]))
            key = mixed(before * ODD + words + np.uint64(n)) & _COUNTED
            out.append((key, place >= n - 1))
    return out


def levels_of(counts: np.ndarray, least: int) -> np.ndarray:
    """Level of each count, from 1 at ``least``."""
    return 1 + np.floor(np.log(counts / least) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, least: int) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    low = least * BASE ** (levels - 1)
    return np.where(levels > 0, (np.ceil(low) + np.ceil(low * BASE) - 1) / 2, 0.0)


def counts_at(levels: np.ndarray, least: int) -> np.ndarray:
    """:func:`count_of` of many levels, looked up."""
    return count_of(np.arange(LEVELS), least)[levels]


def _probe(keys: np.ndarray, level: int, sizes: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of a key at a level, inside the part that the key belongs to, and its bits in that word.

    All probes of a key lie in one word, so a lookup reads memory once.  A part has
    fewer than 2**32 words.
    """
    with np.errstate(over="ignore"):
        hashed = mixed(keys + np.uint64(level) * ODD)
        word = bases + ((hashed >> np.uint64(32)) * sizes >> np.uint64(32))
        mask = np.uint64(1) << (hashed & np.uint64(63))
        for probe in range(1, PROBES):
            mask |= np.uint64(1) << (hashed >> np.uint64(6 * probe) & np.uint64(63))
    return word, mask


class Filter(NamedTuple):
    """Words of all parts end to end; part ``(order - 1) * slices + slice`` begins at ``bases`` and has ``sizes`` words."""

    words: np.ndarray
    bases: np.ndarray
    sizes: np.ndarray
    slices: int
    min_count: int

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Level of each key, 0 for what was never entered."""
        order_of = np.argsort(keys)
        # A key once, and those of a part together: a part alone fits a core's cache.
        keys = keys[order_of]
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        firsts = np.flatnonzero(new)
        found = np.zeros(len(firsts), np.int64)
        for start in range(0, len(firsts), STEP_KEYS):
            own = keys[firsts[start : start + STEP_KEYS]]
            part = (order - 1) * self.slices + slice_of(own, self.slices)
            sizes, bases = self.sizes[part], self.bases[part]
            open_ = np.flatnonzero(sizes > 0)
            at = 1
            while len(open_) and at < LEVELS:
                word, mask = _probe(own[open_], at, sizes[open_], bases[open_])
                open_ = open_[self.words[word] & mask == mask]
                found[start + open_] = at
                at += 1
        level = np.empty(len(keys), np.int64)
        level[order_of] = np.repeat(found, np.diff(firsts, append=len(keys)))
        return level

    def held(self, number: np.ndarray, order: int) -> np.ndarray:
        """Which slices of an order have a part here."""
        return self.sizes[(order - 1) * self.slices + number] > 0

    def levels_at_tokens(self, words: np.ndarray, firsts: np.ndarray, order: int) -> np.ndarray:
        """Levels by order and token; 0 where the part is not here or the history was never entered.

        An n-gram can only be there if its history is, so one whose history's part is here and has
        level 0 is not looked up: :meth:`Model.orders` does not read it.
        """
        distinct, inverse = numbered(words)
        out = np.zeros((order, len(words)), np.uint8)
        out[0] = self.levels(distinct, 1).astype(np.uint8)[inverse]
        gone = self.held(slice_of(distinct, self.slices), 1)[inverse] & (out[0] == 0)
        for n, (keys, valid) in enumerate(gram_keys(words, firsts, order), start=2):
            asked = valid.copy()
            asked[1:] &= ~gone[:-1]
            out[n - 1, asked] = self.levels(keys[asked], n)
            gone = ~asked | self.held(slice_of(keys, self.slices), n) & (out[n - 1] == 0)
        return out


class Model(NamedTuple):
    """What a task needs beside the levels: training tokens, distinct ones, the weights by order and level, and the least count of longer n-grams."""

    tokens: int
    distinct: int
    mixing: np.ndarray
    min_count: int

    def orders(
        self, levels: np.ndarray, firsts: np.ndarray, left_out: bool = False
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(order, known, level, share, lower)`` at every token, from order 2 on, and at last order 0 with the probability as ``lower``.

        ``known``: the history was seen; ``level``: that of its count; ``share``: how
        often this token followed it; ``lower``: the probability after the next
        shorter history.  ``left_out`` takes the token itself out of all counts.
        ``levels`` has a row for each order and a column for each token.
        """
        own = 1 if left_out else 0
        place, level = place_of(firsts), levels[0]
        lower = (np.maximum(counts_at(level, 1) - own, 0) + 1) / (self.tokens - own + self.distinct + 1)
        least = 1
        for n in range(2, len(self.mixing) + 2):
            before = np.concatenate((np.zeros(1, np.int64), level[:-1]))
            times = np.maximum(counts_at(before, least) - own, 0)
            # An n-gram can only be there if its history is.
            known = (place >= n - 1) & (times > 0)
            level, least = np.where(known, levels[n - 1], 0), self.min_count
            seen = np.minimum(np.maximum(counts_at(level, least) - own, 0), times)
            share = np.divide(seen, times, out=np.zeros(len(place)), where=known)
            yield n, known, before, share, lower
            weight = self.mixing[n - 2][before]
            lower = np.where(known, weight * share + (1 - weight) * lower, lower)
        yield 0, level, level, lower, lower

    def log_probabilities(self, levels: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """log10 probability of each token after its history in its text."""
        for *_, lower in self.orders(levels, firsts):
            pass
        return np.log10(lower)


def false_positive_rate(bits_per_entry: float) -> float:
    """Chance that a probe of something never entered hits: over words with a Poisson number of entries."""
    load = 64 / bits_per_entry
    share, total = np.exp(-load), 0.0
    for entries in range(1, int(8 * load) + 64):
        share *= load / entries
        total += share * (1 - (63 / 64) ** (PROBES * entries)) ** PROBES
    return float(total)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Slice of each key by its leading bits; ``slices`` is a power of two."""
    return (keys >> np.uint64(64 - slices.bit_length() + 1)).astype(np.int64) if slices > 1 else np.zeros(len(keys), np.int64)


_ASKED = "order int, slice int, block long, keys binary, counts binary"
_MERGED = "order int, slice int, block long, answer binary, keys binary, levels binary, n_entries long, n_tokens long, n_distinct long"


def _ask(order: int, slices: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, firsts = tokens(*B.texts_of(batch, k))
                held = batch.column("held_out")[k].values.to_numpy(zero_copy_only=False).astype(bool)
                training = ~np.repeat(held, np.diff(firsts))
                block = batch.column("block")[k].as_py()
                keys, inverse = numbered(words)
                asked = [(1, keys, np.bincount(inverse, weights=training, minlength=len(keys)))]
                for n, (grams, valid) in enumerate(gram_keys(words, firsts, order), start=2):
                    asked.append((n, *np.unique(grams[valid & training], return_counts=True)))
                for n, keys, counts in asked:
                    points = np.searchsorted(slice_of(keys, slices), np.arange(slices + 1))
                    rows = [
                        (n, s, block, B.pack_sorted(keys[a:b]), B.pack(counts[a:b].astype(np.uint32)))
                        for s, (a, b) in enumerate(zip(points[:-1], points[1:]))
                        if a < b
                    ]
                    if rows:
                        yield _rows(rows, _ASKED)

    return ask


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for (_, t), c in zip(fields, zip(*rows))], names=[n for n, _ in fields])


def _merge(min_count: int):
    def merge(table: pa.Table) -> pa.Table:
        """Sums counts over blocks; answers single words, and returns the levels of what enters the filter."""
        order, number = table.column("order")[0].as_py(), table.column("slice")[0].as_py()
        keys = [B.unpack_sorted(x) for x in table.column("keys").to_pylist()]
        counts = [B.unpack(x) for x in table.column("counts").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        rows = []
        if order == 1:
            for block, answer in zip(table.column("block").to_pylist(), np.split(totals[inverse], ends[:-1])):
                rows.append((order, number, block, B.pack(answer), None, None, 0, 0, 0))
        least = 1 if order == 1 else min_count
        entered = totals >= least
        levels = levels_of(totals[entered], least)
        statistics = (int(levels.sum()), int(totals.sum()), int((totals > 0).sum())) if order == 1 else (int(levels.sum()), 0, 0)
        rows.append((order, number, None, None, B.pack_sorted(distinct[entered]), B.pack(levels.astype(np.uint8)), *statistics))
        return pa.Table.from_batches([_rows(rows, _MERGED)])

    return merge


def _fill(bits_per_entry: float):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size = part_words(batch.column("n_entries")[k].as_py(), bits_per_entry)
                keys, levels = B.unpack_sorted(batch.column("keys")[k].as_py()), B.unpack(batch.column("levels")[k].as_py())
                words = np.zeros(size, np.uint64)
                for level in range(1, int(levels.max(initial=0)) + 1):
                    np.bitwise_or.at(words, *_probe(keys[levels >= level], level, np.uint64(size), np.uint64(0)))
                packed = words.tobytes()
                yield _rows([(batch.column("order")[k].as_py(), batch.column("slice")[k].as_py(), packed)], "order int, slice int, bits binary")

    return fill


def part_words(entries: int, bits_per_entry: float) -> int:
    """64-bit words of a part, none without entries."""
    return -(-int(entries * bits_per_entry + 1) // 64) if entries else 0


def filters(merged: DataFrame, slices: int, order: int, min_count: int, max_filter_bytes: int) -> Iterator[Filter]:
    """The filter from :func:`_merge`'s rows, in groups of parts of ``max_filter_bytes`` at most, or one part.

    The driver holds the bits of one group.
    """
    number = (F.col("order") - 1) * slices + F.col("slice")
    entered = merged.where("block IS NULL AND n_entries > 0").withColumn("part", number)
    # One row for each order and slice.
    bytes_of = {r["part"]: 8 * part_words(r["n_entries"], BITS_PER_ENTRY) for r in entered.select("part", "n_entries").collect()}
    filled = cut(
        entered.select("order", "slice", "keys", "levels", "n_entries")
        .mapInArrow(_fill(BITS_PER_ENTRY), "order int, slice int, bits binary")
        .withColumn("part", number)
    )
    groups: list[list[int]] = []
    held = 0
    for part, size in sorted(bytes_of.items()):
        if not groups or held + size > max_filter_bytes:
            groups.append([])
            held = 0
        groups[-1].append(part)
        held += size
    for group in groups:
        own = filled.where(F.col("part").between(group[0], group[-1])).select("part", "bits")
        bits = {row["part"]: row["bits"] for row in own.toLocalIterator()}
        sizes = np.array([len(bits.get(i, b"")) // 8 for i in range(order * slices)], np.uint64)
        yield Filter(np.frombuffer(b"".join(bits[i] for i in group), np.uint64), np.cumsum(sizes) - sizes, sizes, slices, min_count)


def _levels(shared, order: int, group: int):
    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Levels of the n-grams in one group of parts, by order and token; 0 for those of other groups."""
        for batch in batches:
            for k in range(batch.num_rows):
                words, firsts = tokens(*B.texts_of(batch, k))
                out = shared.value.levels_at_tokens(words, firsts, order)
                yield _rows([(batch.column("block")[k].as_py(), group, B.pack(out.reshape(-1)))], _LEVELS)

    return levels


_LEVELS = "block long, slice int, answer binary"


def levelled(blocks: DataFrame, merged: DataFrame, slices: int, order: int, min_count: int, max_filter_bytes: int) -> DataFrame:
    """``blocks`` with ``levels``, the answers of a pass for each group of parts."""
    answers = None
    for group, filter_ in enumerate(filters(merged, slices, order, min_count, max_filter_bytes)):
        shared = blocks.sparkSession.sparkContext.broadcast(filter_)
        # Written, so that the group's bits can go.
        own = cut(blocks.select("block", "offsets", "text").mapInArrow(_levels(shared, order, group), _LEVELS))
        shared.destroy()
        answers = own if answers is None else answers.unionByName(own)
    if answers is None:
        answers = blocks.sparkSession.createDataFrame([], _LEVELS)
    return B.answered(blocks, answers, "levels")


def levels_at(batch: pa.RecordBatch, k: int, order: int, count: int) -> np.ndarray:
    """Levels by order and token of block row ``k``; an n-gram has its level from one group at most."""
    out = np.zeros(order * count, np.uint8)
    for answer in B.answers_of(batch, "levels", k):
        out += B.unpack(answer)
    return out.reshape(order, count).astype(np.int64)


def _weigh(model: Model):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Log-likelihood of left-out training tokens by order, level of the history and weight.

        Terms that are the same for every weight are left out.
        """
        for batch in batches:
            for k in range(batch.num_rows):
                words, firsts = tokens(*B.texts_of(batch, k))
                held = batch.column("held_out")[k].values.to_numpy(zero_copy_only=False).astype(bool)
                training = ~np.repeat(held, np.diff(firsts))
                levels = levels_at(batch, k, len(model.mixing) + 1, len(words))
                rows = []
                for n, known, level, share, lower in model.orders(levels, firsts, left_out=True):
                    if not n:
                        break
                    unseen = np.bincount(level[known & training & (share == 0)], minlength=LEVELS)
                    seen = known & training & (share > 0)
                    at, ratio = level[seen], share[seen] / lower[seen]
                    for g, w in enumerate(GRID):
                        sums = unseen * np.log(1 - w) + np.bincount(at, weights=np.log(w * ratio + 1 - w), minlength=LEVELS)
                        rows += [(n, q, g, s) for q, s in enumerate(sums.tolist()) if s]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["order", "level", "grid", "sum"])

    return weigh


def mixing_weights(blocks: DataFrame, model: Model) -> Model:
    """The model with the likeliest weight for each order and level; the model's own weights stand for shorter orders."""
    sums = blocks.select("offsets", "text", "held_out", "levels").mapInArrow(
        _weigh(model), "order long, level long, grid long, sum double"
    )
    best: dict[tuple[int, int], tuple[float, int]] = {}
    # At most orders * LEVELS * len(GRID) rows; a weight of 0 has the sum 0.
    for order, level, grid, value in sums.groupBy("order", "level", "grid").agg(F.sum("sum")).collect():
        best[order, level] = max(best.get((order, level), (0.0, 0)), (value, grid))
    mixing = np.zeros_like(model.mixing)
    for n in range(2, len(mixing) + 2):
        last = 0.0
        for level in reversed(range(LEVELS)):  # a level without tokens takes the next higher one's weight
            last = GRID[best[n, level][1]] if (n, level) in best else last
            mixing[n - 2, level] = last
    return model._replace(mixing=mixing)


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = model.tokens, model.distinct
        for batch in batches:
            for k in range(batch.num_rows):
                words, firsts = tokens(*B.texts_of(batch, k))
                answers = B.answers_of(batch, "counted", k)
                keys, inverse = numbered(words)
                counts = np.concatenate([B.unpack(a) for a in answers])[inverse] if len(keys) else np.zeros(0)
                base = np.add.reduceat(np.log10((counts + 1) / (n + v + 1)), firsts[:-1])
                known = np.add.reduceat((counts > 0).astype(np.int64), firsts[:-1])
                own = np.add.reduceat(model.log_probabilities(levels_at(batch, k, len(model.mixing) + 1, len(words)), firsts), firsts[:-1])
                sizes = np.diff(firsts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[k].values,
                        batch.column("held_out")[k].values,
                        pa.array(sizes, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(np.full(len(sizes), n), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(own, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def score_documents(
    docs: DataFrame,
    held_out: str = "held_out",
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    mixing: np.ndarray | None = None,
    max_filter_bytes: int = MAX_FILTER_BYTES,
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """Every document's log10 probability, from a model of those where ``held_out`` is false.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``:
    tokens are the lower-cased (A-Z) words and one end; ``n_known`` counts those
    that occur in training; ``base_score`` is the exact add-one unigram score and
    ``score`` the model's.  Words are told apart by 64-bit hashes.  ``mixing`` gives
    the weights by order (from 2) and level instead of :func:`mixing_weights`.

    A null or empty text is its end; a null ``held_out`` is false; equal rows count
    and score each; without training documents every token is unknown; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.col(f"`{text}`").alias("text"),
        F.coalesce(F.col(f"`{held_out}`"), F.lit(False)).alias("held_out"),
    )
    blocks = B.write_blocks(rows, "text", ["id", "held_out"], block_bytes)
    slices = 1 << max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    asked = blocks.mapInArrow(_ask(order, slices), _ASKED)
    merged = cut(asked.groupBy("order", "slice").applyInArrow(_merge(min_count), _MERGED))
    n_tokens, n_distinct = (n or 0 for n in merged.where("block IS NULL").agg(F.sum("n_tokens"), F.sum("n_distinct")).first())
    probed = levelled(blocks, merged, slices, order, min_count, max_filter_bytes)
    if mixing is None:
        model = mixing_weights(probed, Model(n_tokens, n_distinct, np.full((order - 1, LEVELS), MEANWHILE), min_count))
    else:
        model = Model(n_tokens, n_distinct, np.asarray(mixing, float), min_count)
    counted = B.answered(probed, merged.where("block IS NOT NULL").select("block", "slice", "answer"), "counted")
    kind = docs.schema[doc_id].dataType.simpleString()
    return counted.mapInArrow(
        _score(model),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
