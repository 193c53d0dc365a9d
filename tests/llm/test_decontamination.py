import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from cases import LONG, ROWS, SF_DIR, empty, frame

from tidemark.llm.decontamination import contamination, decontaminate, find_passages, suffix_array
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        if not w:
            continue
        k = min(window, len(w))
        for i in range(len(w) - k + 1):
            windows.setdefault(k, {}).setdefault(tuple(w[i : i + k]), set()).add(None if item is None else str(item))
    rows = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k, own in windows.items():
            for i in range(len(w) - k + 1):
                if names := own.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(f for f in found if f is not None)).encode()).hexdigest()
        rows.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(rows, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = [
    (7, "QUICK brown fox, jumps over the lazy dog and runs away from all"),
    (8, "another text"),
    (8, "wörds"),
    (9, None),
    (10, ""),
    (None, "the quick brown fox"),
    (11, "beta gamma delta alpha " * 6),
    (12, "漢字 \U0001f600"),
    (12, "漢字 \U0001f600"),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_cases(spark):
    assert result(contamination(frame(spark), items(spark))) == brute(ROWS, ITEMS)


def test_items_in_many_blocks(spark):
    assert result(contamination(frame(spark), items(spark), block_bytes=10)) == brute(ROWS, ITEMS)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()
    want = brute([tuple(r) for r in docs], [tuple(r) for r in bench])
    assert any(r[-1] for r in want)
    assert result(QUERIES["op6_benchmark_decontamination"](spark, SF_DIR)) == want


def test_empty_tables(spark):
    assert result(contamination(empty(spark), items(spark))) == []
    got = contamination(frame(spark), items(spark, []))
    assert result(got) == brute(ROWS, [])


def test_clashing_columns_stay(spark):
    docs = frame(spark, clash=("n_words", "MATCHES", "item_id", "_row"))
    kept = decontaminate(docs, items(spark))
    assert kept.columns == docs.columns
    clean = [d for d, *_, bad in brute(ROWS, ITEMS) if not bad]
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted(clean, key=repr)
    _, *names = find_passages(docs, items(spark))
    assert names == ["_n_words", "_matches", "items"]


def test_longest_passages(spark):
    found, *_ = find_passages(frame(spark, [(1, "x " + ITEMS[0][1] + " y")]), items(spark, ITEMS[:1]))
    (match,) = found.first()["matches"]
    assert tuple(match) == ("7", 0, 1, 13)
    long_, *_ = find_passages(frame(spark, [(1, LONG)]), items(spark, [(1, LONG)]))
    lengths = [m["length"] for m in long_.first()["matches"]]
    assert max(lengths) == 80_000


def test_every_item_has_its_longest_passage(spark):
    """Items that share a beginning with another, a nameless one among them, each against brute force."""
    rng = np.random.default_rng(9)
    text = lambda n: [str(x) for x in rng.choice(list("abcdefgh"), n)]
    head = text(20)
    bench = [(1, head + text(10)), (2, head + text(20)), (3, text(5) + head), (None, head[3:18])]
    doc = text(7) + bench[1][1] + text(9) + bench[0][1][:25] + text(4)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in bench], "item_id long, text string")
    found, *_ = find_passages(frame(spark, [(1, " ".join(doc))]), rows)
    longest = {}
    for m in found.first()["matches"]:
        longest[m["item_id"]] = max(longest.get(m["item_id"], 0), m["length"])
        item = next(w for i, w in bench if (None if i is None else str(i)) == m["item_id"])
        assert doc[m["doc_start"] : m["doc_start"] + m["length"]] == item[m["item_start"] : m["item_start"] + m["length"]]
    for item, w in bench:
        want = max(n for a in range(len(w)) for b in range(len(doc)) for n in [next((k for k in range(len(w) - a) if b + k >= len(doc) or w[a + k] != doc[b + k]), len(w) - a)])
        assert longest[None if item is None else str(item)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 12))
def test_suffix_array(values, depth):
    numbers = np.array([*values, 0], np.int64)
    array = suffix_array(numbers, depth, 3)
    assert sorted(array.tolist()) == [i for i, v in enumerate(values) if v]

    def key(i):
        tail = []
        while numbers[i] and len(tail) < depth:
            tail.append(int(numbers[i]))
            i += 1
        return tail

    keys = [key(i) for i in array]
    assert keys == sorted(keys)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "d"], n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(60)]
    bench = [(i, text(int(rng.integers(0, 14)))) for i in range(12)]
    got = result(contamination(frame(spark, docs), items(spark, bench), window=5))
    assert got == brute(docs, bench, 5)
