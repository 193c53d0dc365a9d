import random

import corpus_pipeline
import numpy as np
import pytest
from cases import ROWS, SF_DIR, empty, frame
from test_simhash import reach

from tidemark.llm import near_copies
from tidemark.llm.near_copies import drop_near_copies, first_shingles, similarity

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows):
    """Smallest id of each group over all pairs."""
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    groups = {}
    for (doc, _), root in zip(rows, reach(len(rows), pairs)):
        groups.setdefault(root, []).append(doc)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=repr)


def kept(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


def planted(most, groups=40, words=300):
    """Originals, and a copy of each with up to ``most`` words changed: similarities from 0.7 to 1."""
    rng, rows = random.Random(3), []
    for group in range(groups):
        text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        rows.append((2 * group, " ".join(text)))
        for at in rng.sample(range(words), 1 + group % most):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((2 * group + 1, " ".join(text)))
    return rows


def test_pipeline_stage_finds_planted_copies(spark):
    rows = planted(10)
    by_id = {d: shingles(t) for d, t in rows}
    near = {d for d in by_id if d % 2 and jaccard(by_id[d], by_id[d - 1]) >= 0.8}
    assert 20 <= len(near) < 40 and any(jaccard(by_id[d], by_id[d - 1]) < 0.85 for d in near)
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows, clash=("row", "near_set")), "")
    assert got.columns == ["doc_id", "text", "row", "near_set"]
    assert set(kept(got)) == set(by_id) - near


def test_dense_group(spark):
    """Copies of one text that mostly do not link to one another, as in a page template."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for doc in range(150):
        text = list(base)
        for at in rng.sample(range(120), 3):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((doc, " ".join(text)))
    assert kept(drop_near_copies(frame(spark, rows))) == brute(rows)


def test_common_passage(spark):
    """Unlike texts with one long passage in common, from a tenth to nine tenths of a text, and copies among them."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for doc in range(200):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([10, 15, 20, 30, 100, 400]))]
        text = own + passage if doc % 2 else passage + own
        rows.append((2 * doc, " ".join(text)))
        if doc % 5 == 0:
            text[rng.randrange(len(text))] = "changed"
            rows.append((2 * doc + 1, " ".join(text)))
    assert 0 < len(brute(rows)) < len(rows)
    assert kept(drop_near_copies(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("words,edits", [(56, 1), (60, 2), (90, 3)])
@pytest.mark.parametrize("with_base", [True, False])
def test_group_without_its_origin(spark, words, edits, with_base):
    """Copies that link to the text they come from, or, where that is gone, to copies changed at the same place."""
    rng = random.Random(words)
    base = [f"w{i}" for i in range(words)]
    rows = [(10_000, " ".join(base))] if with_base else []
    for doc in range(250):
        text = list(base)
        for at in rng.sample(range(words), rng.randrange(1, edits + 1)):
            text[at] = f"x{rng.randrange(30)}"
        rows.append((doc, " ".join(text)))
    assert kept(drop_near_copies(frame(spark, rows))) == brute(rows)


def test_small_sets_of_frequent_lines(spark):
    """Texts that are nothing but frequent lines: their shingles are keys all the same."""
    rng = random.Random(6)
    lines = [" ".join(f"l{k}w{i}" for i in range(rng.randrange(3, 9))) for k in range(12)]
    rows = [(doc, " . ".join(rng.sample(lines, rng.randrange(1, 9)))) for doc in range(300)]
    assert kept(drop_near_copies(frame(spark, rows))) == brute(rows)


def test_first_shingles_meet():
    """Any two sets of similarity 0.8 or more share a key, whatever the counts."""
    rng = np.random.default_rng(7)
    met = 0
    for _ in range(3000):
        size = int(rng.integers(1, 60))
        base = np.unique(rng.integers(0, 10**6, size, dtype=np.uint64))
        level = dict(zip(base.tolist(), rng.integers(1, 4, len(base)).tolist()))
        other = base[rng.random(len(base)) < 0.93]
        other = np.unique(np.concatenate([other, rng.integers(10**6, 2 * 10**6, int(rng.integers(0, 4)), dtype=np.uint64)]))
        if similarity(base, other) < 0.8:
            continue
        met += 1
        keys = [set(first_shingles(g, np.array([level.get(x, 0) for x in g.tolist()], np.uint8), 0.8)[0].tolist()) for g in (base, other)]
        # Here shingles of level 0 are those that only one of the two has.
        if all(level.get(x, 0) for x in set(base.tolist()) & set(other.tolist())):
            assert keys[0] & keys[1]
    assert met > 500


def test_cases(spark):
    assert kept(drop_near_copies(frame(spark))) == brute(ROWS)
    assert drop_near_copies(empty(spark)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert kept(corpus_pipeline.near_dedup(spark, docs, SF_DIR)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_sets_are_not_shuffled(spark, monkeypatch):
    """Only sets that meet another are written, and comparing moves the pairs with one set of each, not all sets."""
    compared, seen = near_copies._compared, []

    def watched(pairs, sets, least):
        out = compared(pairs, sets, least)
        plan = out._jdf.queryExecution().executedPlan().toString()
        seen.append((sets.count(), plan.count("Exchange hashpartitioning")))
        return out

    monkeypatch.setattr(near_copies, "_compared", watched)
    monkeypatch.setattr(near_copies, "spread_join", lambda big, small, on: big.join(small, on))  # no leader is frequent here
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(50)]
    rows += [(100 + i, " ".join([*(f"c{i // 2}x{k}" for k in range(100)), f"end{i}"])) for i in range(60)]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")  # as with sets that are too large
    try:
        assert kept(drop_near_copies(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset(threshold)
    assert len(seen) > 1 and all(count == 60 and moved <= 2 for count, moved in seen)
