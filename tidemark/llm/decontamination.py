"""Documents that hold passages of a benchmark, found with suffix arrays over the documents.

The documents of a task are cut into shards of whole documents.  A shard's words
become numbers of the benchmark's vocabulary (0: not in it, also between
documents) and its suffixes are sorted by prefix doubling.  Every benchmark
suffix is then found by binary search, one word deeper at a time and all
suffixes together.  A document lies in one shard, so nothing is shuffled, and
copies or a hot source cost what their words cost.

Words are compared by 64-bit hashes.  A suffix is sorted only up to its first
word outside the vocabulary: no benchmark suffix goes on beyond it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.rows import appended, fresh, schema_with, steps, text_buffer
from tidemark.llm.words import hash_text_words, hash_words, lower_table, spans
from tidemark.plans.durable import cut

WINDOW = 10
#: Text of benchmark items that is broadcast at a time; more items make more passes.
BLOCK_BYTES = 16 << 20
#: Text of one shard.
SHARD_BYTES = 4 << 20

MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.StringType()),
            T.StructField("item_start", T.IntegerType()),
            T.StructField("doc_start", T.IntegerType()),
            T.StructField("length", T.IntegerType()),
        ]
    )
)
_ARROW_MATCH = pa.struct(
    [("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]
)


class TestSet:
    """The words of some benchmark items as numbers, and the distinct windows among their suffixes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = [hash_text_words(text, "alnum", lower=True) for _, text in items]
        self.names = [name for (name, _), w in zip(items, words) if len(w)]
        words = [w for w in words if len(w)]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(flat)
        self.numbers = np.searchsorted(self.vocabulary, flat).astype(np.int64) + 1
        sizes = np.array([len(w) for w in words], np.int64)
        depth = np.minimum(sizes, window)
        counts = sizes - depth + 1  # windows of an item
        self.item = np.repeat(np.arange(len(words)), counts)
        self.item_start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.start = (np.cumsum(sizes) - sizes)[self.item] + self.item_start
        depth = depth[self.item]
        seen: dict[bytes, int] = {}
        #: Per window: which distinct window it is.
        self.kind = np.fromiter(
            (seen.setdefault(self.numbers[a : a + n].tobytes(), len(seen)) for a, n in zip(self.start, depth)),
            np.int64,
            len(depth),
        )
        #: Per distinct window: the first window with its words, its length, and its items.
        self.first = np.unique(self.kind, return_index=True)[1]
        self.depth = depth[self.first]
        #: Items of each distinct window, and the first window with its words in each of them.
        pairs, self.first_in = np.unique(self.kind * max(1, len(words)) + self.item, return_index=True)
        pair_kind, self.pair_item = np.divmod(pairs, max(1, len(words)))
        self.pairs_of = np.searchsorted(pair_kind, np.arange(len(self.first) + 1))
        self.items = np.split(self.pair_item, self.pairs_of[1:-1]) if len(depth) else []


def suffix_array(numbers: np.ndarray, depth: int, vocabulary: int) -> np.ndarray:
    """Positions of nonzero numbers, sorted by what follows up to the first 0, at least ``depth`` deep.

    ``numbers`` ends with a 0.
    """
    bits = max(1, int(vocabulary).bit_length())
    held = max(1, min(62 // bits, depth))
    size = len(numbers)
    stop = np.flatnonzero(numbers == 0)
    runs = stop[np.searchsorted(stop, np.arange(size))] - np.arange(size)  # words before the next 0
    at = np.flatnonzero(numbers)
    key = numbers[at].copy()
    for k in range(1, held):
        following = numbers[np.minimum(at + k, size - 1)]
        key = (key << bits) | np.where(runs[at] > k, following, 0)
    order = np.argsort(key)
    array, key = at[order], key[order]
    rank = np.zeros(size, np.int64)  # 1 + place of the first suffix of the group; 0 where a run is over
    fresh_group = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(fresh_group, np.arange(len(array)), 0)) if len(array) else array
    rank[array] = group + 1
    done = held
    while done < depth and len(array):
        longer = runs[array] > done
        sizes = np.bincount(group, minlength=len(array))
        tied = (sizes[group] > 1) & (np.bincount(group, weights=longer, minlength=len(array))[group] > 0)
        places = np.flatnonzero(tied)
        if not len(places):
            break
        members = array[places]
        second = np.where(runs[members] > done, rank[np.minimum(members + done, size - 1)], 0)
        own = group[places]
        order = np.lexsort((second, own))
        members, second = members[order], second[order]
        array[places] = members
        starts = np.concatenate(([True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])))
        group[places] = np.maximum.accumulate(np.where(starts, places, 0))
        rank[members] = group[places] + 1
        done *= 2
    return array


def _bound(numbers: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, word: np.ndarray, right: bool) -> np.ndarray:
    """First place in ``low:high`` whose word at depth ``k`` is not below (right: is above) ``word``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        seen = numbers[np.minimum(array[np.minimum(middle, len(array) - 1)] + k, len(numbers) - 1)]
        below = (seen <= word) if right else (seen < word)
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)


def find(numbers: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """``(distinct window, position)`` of every occurrence, by binary search in the suffix array."""
    none = np.zeros(0, np.int64)
    if not len(tests.first):
        return none, none
    array = suffix_array(numbers, int(tests.depth.max()), len(tests.vocabulary))
    begin = tests.start[tests.first]
    active = np.arange(len(begin))
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(array), np.int64)
    who, where = [none], [none]
    for k in range(int(tests.depth.max()) + 1):
        full = tests.depth[active] == k
        for i in np.flatnonzero(full):
            who.append(np.full(high[i] - low[i], active[i]))
            where.append(array[low[i] : high[i]])
        active, low, high = active[~full], low[~full], high[~full]
        if not len(active):
            break
        word = tests.numbers[begin[active] + k]
        first = _bound(numbers, array, low, high, k, word, right=False)
        high = _bound(numbers, array, first, high, k, word, right=True)
        kept = first < high
        active, low, high = active[kept], first[kept], high[kept]
    return np.concatenate(who), np.concatenate(where)


def passages(who: np.ndarray, where: np.ndarray, tests: TestSet) -> list[tuple[int, int, int, int]]:
    """Longest verbatim passages ``(item, item start, position, length)`` of each item from the occurrences of windows.

    Item by item, from left to right: a window goes on with the passage before it if the item
    does; else it starts a passage where the item first has its words.
    """
    sizes = np.diff(tests.pairs_of)[who]
    pair = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(tests.pairs_of[who], sizes)
    where, who = np.repeat(where, sizes), np.repeat(who, sizes)
    order = np.lexsort((where, tests.depth[who], tests.pair_item[pair]))
    found: list[tuple[int, int, int, int]] = []
    kind, item = tests.kind.tolist(), tests.item.tolist()
    kind.append(-1)
    item.append(-1)
    test = place = head = length = -2
    own, start = tests.pair_item[pair][order].tolist(), tests.first_in[pair][order].tolist()
    for k, at, i, begin in zip(who[order].tolist(), where[order].tolist(), own, start):
        if at == place + 1 and item[head] == i and kind[test + 1] == k and item[test + 1] == i:
            test, place, length = test + 1, at, length + 1
            continue
        if length > 0:
            found.append((item[head], int(tests.item_start[head]), place - (test - head), length))
        test = head = begin
        place, length = at, int(tests.depth[k])
    if length > 0:
        found.append((item[head], int(tests.item_start[head]), place - (test - head), length))
    return found


def _search(tests: TestSet, batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """Per row: number of words, passages, and the items that occur."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    data = lower_table()[data]
    starts, ends, firsts = spans(data, offsets, "alnum")
    counts = np.diff(firsts)
    found: list[list[dict]] = [[] for _ in range(len(counts))]
    items: list[list[str]] = [[] for _ in range(len(counts))]
    if len(starts) and len(tests.vocabulary):
        hashes = hash_words(data, starts, ends)
        place = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
        known = np.where(tests.vocabulary[place] == hashes, place + 1, 0)
        document = np.repeat(np.arange(len(counts)), counts)
        numbers = np.zeros(len(starts) + len(counts) + 1, np.int64)  # a 0 after each document
        numbers[np.arange(len(starts)) + document] = known
        begins = firsts[:-1] + np.arange(len(counts))
        row_of = lambda at: np.searchsorted(begins, at, side="right") - 1
        who, where = find(numbers, tests)
        for item, start, at, length in passages(who, where, tests):
            row = int(row_of(at))
            found[row].append(
                {"item_id": tests.names[item], "item_start": start, "doc_start": at - int(begins[row]), "length": length}
            )
        for row, kind in np.unique(np.stack([row_of(where), who]), axis=1).T.tolist():
            items[row] += [tests.names[i] for i in tests.items[kind]]
    return counts, found, [_named(names) for names in items]


def _named(names: Iterable[str | None]) -> list[str | None]:
    """Distinct names in order, null last."""
    return sorted(set(names), key=lambda n: (n is None, n or ""))


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items as lists of about ``block_bytes`` of text, streamed through the driver."""
    block, size = [], 0
    for name, words in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        if not words:
            continue
        block.append((name, words))
        size += len(words)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str, str, str]:
    """``docs`` with its number of words, the longest verbatim passages of benchmark items, and those items.

    Returns the DataFrame and the names of the three columns added, ``n_words``,
    ``matches`` and ``items`` (underscores in front where ``docs`` has such a
    column).  A passage has at least ``window`` words, or is a whole item of fewer;
    words that several items share are reported for each of them.  The benchmark is
    the query set: it goes to the tasks in blocks of bounded size, and each block
    passes over all documents.  With several blocks the result of each is written, so that the driver and the
    tasks hold one block at a time.

    Null and empty texts have no words and no matches; items without words match
    nothing; items that share an id are one item, so are those with a null id, whose matches have
    no name; equal rows give equal results; an empty benchmark or table gives no matches or no rows.
    """
    count, matches, items = (fresh(docs, name) for name in ("n_words", "matches", "items"))
    context = docs.sparkSession.sparkContext
    docs_columns = list(range(len(docs.columns)))
    blocks = blocks_of(benchmark, item_id, item_text, block_bytes)
    added = [(count, T.LongType()), (matches, MATCH), (items, T.ArrayType(T.StringType()))]
    out, k, block = docs, 0, next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        shared = context.broadcast(TestSet(block, window))

        def search(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, text, SHARD_BYTES):
                counts, found, names = _search(shared.value, batch, text)
                if not first:
                    found = [a + b for a, b in zip(batch.column(batch.schema.get_field_index(matches)).to_pylist(), found)]
                    before = batch.column(batch.schema.get_field_index(items)).to_pylist()
                    names = [_named([*a, *b]) for a, b in zip(before, names)]
                    batch = batch.select(docs_columns)
                yield appended(
                    batch,
                    **{
                        count: pa.array(counts, pa.int64()),
                        matches: pa.array(found, pa.list_(_ARROW_MATCH)),
                        items: pa.array(names, pa.list_(pa.string())),
                    },
                )

        out = out.mapInArrow(search, schema_with(docs, *added))
        if following is not None:
            out = cut(out)
            shared.destroy()
        k, block = k + 1, following
    return out, count, matches, items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words inside any passage, ``n_items`` the items that have one (all items with a null id are
    one, which the digest leaves out).
    Of ``docs`` only ``doc_id`` and ``text`` are read.  Cases as in :func:`find_passages`.
    """
    found, *_ = find_passages(docs.select("doc_id", "text"), benchmark, window=window, **options)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items, sums = [], [], []
            for found, names in zip(batch.column("matches").to_pylist(), batch.column("items").to_pylist()):
                reach = total = 0
                for start, end in sorted((m["doc_start"], m["doc_start"] + m["length"]) for m in found):
                    total += max(0, end - max(start, reach))
                    reach = max(reach, end)
                hits.append(total)
                items.append(len(names))
                sums.append(hashlib.sha256(",".join(n for n in names if n is not None).encode()).hexdigest())
            hits = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    hits,
                    pa.array(items, pa.int64()),
                    pa.array(sums, pa.string()),
                    pa.array([h > 0 for h in hits.to_pylist()], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "n_words", "matches", "items").mapInArrow(
        digest,
        f"doc_id {key}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark; columns unchanged.

    Null and empty texts stay; repeated rows go or stay together; null ids are judged by their text;
    an empty benchmark keeps all, an empty table gives none.
    """
    found, _, matches, _ = find_passages(docs, benchmark, window=window, **options)
    return found.where(F.size(F.col(f"`{matches}`")) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
