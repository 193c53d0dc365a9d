import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, ROWS, empty, frame

from tidemark.llm.lexical_search import IMPACT_LIMIT, Best, Items, Weights, blocks_of, search

LOWER = {i: i + 32 for i in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document against every item, in whole numbers."""
    docs = [(d, Counter(t), len(t)) for d, text in docs if (t := terms(text))]
    count, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in docs:
            m = 100 - 75 + 75 * n * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame_of(spark, rows, *clash):
    return frame(spark, rows, clash).withColumnRenamed("doc_id", "item_id")


ITEMS = [(1, "the quick brown fox"), (2, None), (3, ""), (4, "alpha ALPHA beta"), (5, "nowhere to find"), (6, "漢字 wörds Wörds"), (7, " ,. "), (8, LONG)]


def test_cases(spark):
    items = frame_of(spark, ITEMS, "rank", "terms")
    assert got(search(frame(spark, clash=("n", "score", "block")), items)) == brute(ROWS, ITEMS)
    assert got(search(frame(spark), items, k=2)) == brute(ROWS, ITEMS, 2)
    for none in (search(empty(spark), items), search(frame(spark), items.limit(0)), search(frame(spark), frame_of(spark, [(1, None)]))):
        assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


def test_ties_and_blocks(spark):
    """Groups of equal texts larger than a tile, and a block for nearly each item."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "w1 w2 w3") for i in range(5000)] + [(9000 + i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(300)]
    rng.shuffle(rows)
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(50, "w1 w2 w3"), (50, "w1 w2 w3")]
    docs, asked = frame(spark, rows).repartition(7), frame_of(spark, items)
    want = brute(rows, items)
    assert got(search(docs, asked)) == want
    assert got(search(docs, asked, block_cells=40)) == want
    assert sorted((r[1], r[2]) for r in want if r[0] == 50) == [(1 + i // 2, i // 2) for i in range(20)]


def test_layers_keep_sums_exact():
    """Weights near 2**53 are parted, and the sum of the layers is the exact one."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(1, 9, 200, dtype=np.uint64) for _ in range(5)]
    items = Items(pa.array(range(5)), texts)
    weight = rng.integers(10**7, 4 * 10**9, len(items.vocabulary))
    weights = Weights(items, weight)
    assert len(weights.layers) > 10
    for tiles in weights.layers:
        assert max(sum(m.sum(axis=1) for _, m in tiles)) * IMPACT_LIMIT < 2**53
    impacts = rng.integers(1, 10**6, (len(items.vocabulary), 3))
    term, doc = (x.ravel() for x in np.indices(impacts.shape))
    found = weights.scores(term, doc, impacts.ravel(), 3)
    for i, text in enumerate(texts):
        for d in range(3):
            assert found[i, d] == sum(int(weight[t]) * int(impacts[t, d]) for t in np.searchsorted(items.vocabulary, text))


@pytest.mark.parametrize("kind", ["int", "text"])
def test_best_of_tiles(kind):
    rng = np.random.default_rng(7)
    best, seen = Best(3, 4), []
    for _ in range(30):
        scores = rng.integers(0, 4, (4, 6))
        ids = [int(x) if kind == "int" else f"d{x}" for x in rng.integers(0, 500, 6)]
        best.add(scores, pa.array(ids))
        seen.append((scores, ids))
    for item in range(4):
        rows = sorted((-int(s[item, j]), i) for s, ids in seen for j, i in enumerate(ids) if s[item, j] > 0)[:3]
        mine = [(-int(s), i.as_py()) for it, s, i in zip(best.item, best.score, best.ids) if it == item]
        assert sorted(mine) == rows


def test_blocks_are_bounded(spark):
    rows = [(i, f"a{i} b{i} c{i}") for i in range(20)] + [(99, " ".join(f"z{i}" for i in range(100)))]
    blocks = list(blocks_of(frame_of(spark, rows), "item_id", "text", 48))
    assert sum(len(b.names) for b in blocks) == 21
    assert all(len(b.names) * len(b.vocabulary) <= 48 or len(b.names) == 1 for b in blocks)
