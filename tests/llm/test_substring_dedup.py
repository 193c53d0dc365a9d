import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from cases import ROWS, SF_DIR, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import blocks as B
from tidemark.llm import substring_dedup as S
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=35):
    words = [WORD.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cases(spark):
    got = result(S.remove_repeats(frame(spark, clash=("block", "offsets", "kept", "id")), window=5))
    assert got == brute(ROWS, 5)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_blocks_do_not_matter(spark, block_bytes):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 50))))) for i in range(80)]
    assert result(S.remove_repeats(frame(spark, rows), window=7, block_bytes=block_bytes)) == brute(rows, 7)


def test_narrow_sketch_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(map(str, rng.integers(0, 40, int(rng.integers(0, 60)))))) for i in range(40)]
    rows += rows[:6]
    monkeypatch.setattr(S, "COUNTERS", 0.05)
    assert result(S.remove_repeats(frame(spark, rows), window=6)) == brute(rows, 6)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows)), key=repr)
    assert any(g for _, _, g, _ in want)
    assert result(QUERIES["op5_substring_dedup"](spark, SF_DIR)) == want


def test_empty(spark):
    assert result(S.remove_repeats(empty(spark))) == []
    assert result(S.remove_repeats(frame(spark, [(1, None), (2, "a b")]))) == [(1, 0, 0, ""), (2, 2, 0, "a b")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.booleans(), max_size=50))
def test_packing(keys, flags):
    keys = np.array(sorted(keys), np.uint64)
    assert (B.unpack_sorted(B.pack_sorted(keys)) == keys).all()
    assert B.unpack_bits(B.pack_bits(np.array(flags, bool)), len(flags)).tolist() == flags


def test_sketch_never_counts_too_few(spark):
    """Merged counters are at least the count, up to 2."""
    import pyarrow as pa

    width, slices = 64, 4
    rng = np.random.default_rng(0)
    windows = [rng.integers(0, 300, 60, dtype=np.uint64) for _ in range(5)]
    held = 2 * width // slices
    rows = {s: [] for s in range(slices)}
    for block, w in enumerate(windows):
        slots, counts = np.unique(np.concatenate(S._slots(w, w * np.uint64(7), width)), return_counts=True)
        for s, a, b in S._sliced(slots, slices, held):
            rows[s].append((s, block, B.pack_sorted(slots[a:b]), B.pack_bits(counts[a:b] > 1)))
    total = Counter(int(x) for w in windows for x in np.concatenate(S._slots(w, w * np.uint64(7), width)))
    for s, own in rows.items():
        merged = S._merge_sketch(width, slices)(pa.Table.from_batches([S._batch(own, ["slice", "block", "keys", "twice"])]))
        for (_, _, keys, _), answer in zip(own, merged.column("answer").to_pylist()):
            slots = B.unpack_sorted(keys)
            flags = B.unpack_bits(answer, len(slots))
            assert flags.tolist() == [total[int(x)] > 1 for x in slots]


def test_numbered():
    values = np.array([7, 3, 7, 2**63, 0, 3], np.uint64)
    slots, number = S._numbered(values)
    assert slots.tolist() == [0, 3, 7, 2**63] and slots[number].tolist() == values.tolist()
    assert [len(x) for x in S._numbered(values[:0])] == [0, 0]


def test_candidates_cost_little_beside_their_windows():
    """A block's slots are told apart by sorting; hashing them took several times as long as making the windows."""
    words = np.random.default_rng(1).integers(0, 10**6, 500_000)
    texts = [" ".join(map(str, part.tolist())).encode() for part in np.split(words, 500)]
    data, edges = b"".join(texts), np.cumsum([0, *map(len, texts)])
    batch = B.pa.table({"text": [B.squeeze(data)], "offsets": [B.pack(edges)], "sketched": B.pa.array([None], B.pa.list_(B.pa.int64()))}).to_batches()[0]
    frombuffer = np.frombuffer(data, np.uint8)
    windows, candidates = [], []
    for _ in range(3):
        began = time.process_time()
        at, *_ = S.windows(frombuffer, edges, 35)
        windows.append(time.process_time() - began)
        width, began = 4 * len(at), time.process_time()
        slices = np.ones(2 * width, bool)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(B, "answers_of", lambda *_: [B.pack_bits(slices)])
            S._candidates(batch, 0, 35, width, 1)
        candidates.append(time.process_time() - began)
    assert min(candidates) < 4 * min(windows)
