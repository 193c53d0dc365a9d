import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from cases import ROWS, SF_DIR, empty, frame
from pyspark.sql import functions as F

from tidemark.llm import bloom_lm as L
from tidemark.llm.queries import QUERIES

LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


@cache
def level_count(count, least):
    if count < least:
        return 0.0
    inside = [c for c in range(least, 2 * count + 2) if level(c, least) == level(count, least)]
    return (inside[0] + inside[-1]) / 2


MIXING = np.linspace(0.05, 0.9, 2 * L.LEVELS).reshape(2, L.LEVELS)


def level(count, least):
    return 0 if count < least else 1 + math.floor(math.log(count / least) / math.log(1.4) + 1e-9)


def brute(rows, order=3, least=2, mixing=MIXING):
    """Rows ``(id, held out, text)`` scored with exact tables of quantised counts."""
    grams = [Counter() for _ in range(order)]
    for _, held, text in rows:
        if not held:
            t = tokens(text)
            for n in range(order):
                grams[n].update(tuple(t[i - n : i + 1]) for i in range(n, len(t)))
    total, distinct = sum(grams[0].values()), len(grams[0])
    out = []
    for doc, held, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for i, word in enumerate(t):
            base += math.log10((grams[0][(word,)] + 1) / (total + distinct + 1))
            chance = (level_count(grams[0][(word,)], 1) + 1) / (total + distinct + 1)
            for n in range(1, min(order, i + 1)):
                times, low = grams[n - 1][tuple(t[i - n : i])], least if n > 1 else 1
                if times < low:
                    break
                before = level_count(times, low)
                seen = min(level_count(grams[n][tuple(t[i - n : i + 1])], least), before)
                weight = mixing[n - 1][level(times, low)]
                chance = weight * seen / before + (1 - weight) * chance
            score += math.log10(chance)
        out.append((doc, held, len(t), sum(grams[0][(w,)] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, df.collect())), key=repr)


def held(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 7 == 2


def with_held(spark, rows):
    return spark.createDataFrame([(d, t, held(d)) for d, t in rows], "doc_id long, text string, held_out boolean")


@pytest.fixture
def wide(monkeypatch):
    # All probes of an entry lie in one word: false positives vanish only with very thin words.
    monkeypatch.setattr(L, "BITS_PER_ENTRY", 400)


def test_cases(spark, wide):
    docs = with_held(spark, ROWS).withColumn("block", F.lit(1)).withColumn("counted", F.lit("x")).withColumn("id", F.lit(0))
    assert result(L.score_documents(docs, mixing=MIXING)) == brute([(d, held(d), t) for d, t in ROWS])


def test_whole_table(spark, wide):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = brute([(d, held(d), t) for d, t in rows])
    got = result(L.score_documents(with_held(spark, rows), mixing=MIXING))
    assert [r[:6] for r in got] == [r[:6] for r in want]
    ours, exact = (np.array([r[6] for r in x]) for x in (got, want))
    # A rare false positive may raise a count.
    assert np.isclose(ours, exact, rtol=1e-6).mean() > 0.95 and np.allclose(ours, exact, rtol=0.01)
    # The query differs in its own weights only.
    assert [r[:6] for r in result(QUERIES["op8_bloom_language_model"](spark, SF_DIR))] == [r[:6] for r in want]


def test_held_out_text_is_likelier_than_by_single_words(spark):
    got = QUERIES["op8_bloom_language_model"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_blocks_do_not_matter(spark, wide):
    docs = with_held(spark, ROWS)
    assert result(L.score_documents(docs, block_bytes=64)) == result(L.score_documents(docs))


def test_weights_follow_the_text(spark, wide):
    """Where each word fixes the next one the longer history is trusted, where words are drawn it is not."""
    rng = np.random.default_rng(0)
    chain = " ".join(f"w{i}" for i in range(40))
    drawn = lambda: " ".join(f"w{i}" for i in rng.integers(0, 40, 40))
    ends = {}
    for name, rows in (("chain", [(i, chain) for i in range(60)]), ("drawn", [(i, drawn()) for i in range(60)])):
        docs = frame(spark, rows).withColumn("held_out", F.col("doc_id") >= 50)
        out = L.score_documents(docs).where("held_out").agg(F.avg("score"), F.avg("base_score")).first()
        ends[name] = out[0] - out[1]
    assert ends["chain"] > 40
    assert ends["drawn"] > -3


def test_empty_and_untrained(spark):
    assert L.score_documents(empty(spark).withColumn("held_out", F.lit(True))).count() == 0
    rows = [(1, "a b"), (2, None)]
    got = result(L.score_documents(frame(spark, rows).withColumn("held_out", F.lit(True))))
    assert got == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]


def test_small_filter_holds_every_entry(spark):
    """With far too few bits counts grow by chance, but none is lost."""
    rows = [(i, f"w{i % 50} w{i % 7} w{i % 3}") for i in range(300)]
    docs = frame(spark, rows).withColumn("held_out", F.lit(False))
    tight = {r["doc_id"]: r for r in L.score_documents(docs, max_filter_bytes=400).collect()}
    roomy = {r["doc_id"]: r for r in L.score_documents(docs).collect()}
    assert all(tight[i]["base_score"] == roomy[i]["base_score"] and tight[i]["n_known"] == 4 for i in tight)


def test_groups_of_parts_score_alike(spark):
    """What is broadcast at a time is bounded, and every entry keeps its bits."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").withColumn("held_out", F.col("doc_id") % 7 == 2)
    one, many = (result(L.score_documents(docs, max_filter_bytes=most)) for most in (1 << 28, 1 << 13))
    assert many == one


def test_error_rate():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    size = L.part_words(len(keys), L.BITS_PER_ENTRY)
    words = np.zeros(size, np.uint64)
    np.bitwise_or.at(words, *L._probe(keys, 1, np.uint64(size), np.uint64(0)))
    own = L.Filter(words, np.zeros(1, np.uint64), np.array([size], np.uint64), 1, 2)
    assert (own.levels(keys, 1) > 0).all()
    others = rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    rate = (own.levels(others, 1) > 0).mean()
    assert rate < 1.5 * L.false_positive_rate(L.BITS_PER_ENTRY) < 0.05


def test_probes_are_few(monkeypatch):
    """A key is probed once however often it occurs, and not at all if its history was never entered."""
    texts = ["a b c " * 100, "x y z " * 100]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    words, firsts = L.tokens(data, np.cumsum([0, *map(len, texts)]))
    entered = [words[:3]] + [np.unique(key[valid][:100]) for key, valid in L.gram_keys(words, firsts, 3)]
    sizes = np.array([L.part_words(len(k), 400) for k in entered], np.uint64)
    own = L.Filter(np.zeros(int(sizes.sum()), np.uint64), np.cumsum(sizes) - sizes, sizes, 1, 2)
    for keys, size, base in zip(entered, sizes, own.bases):
        np.bitwise_or.at(own.words, *L._probe(keys, 1, size, base))
    probe, probed = L._probe, []
    monkeypatch.setattr(L, "_probe", lambda keys, level, *rest: probed.append((level, len(keys))) or probe(keys, level, *rest))
    levels = own.levels_at_tokens(words, firsts, 3)
    # Words a, b, c, x, y, z and the end; ab, bc, ca and c with the end; four after them at most.
    assert sum(n for level, n in probed if level == 1) <= 7 + 4 + 4
    assert (levels[0, :300] > 0).all() and (levels[1, 1:100] > 0).all() and (levels[2, 2:100] > 0).all()
    assert not levels[1:, firsts[1] :].any()


def test_levels():
    counts = np.array([1, 2, 3, 4, 7, 8, 1000])
    assert L.levels_of(counts, 1).tolist() == [level(int(c), 1) for c in counts]
    assert L.count_of(L.levels_of(counts, 1), 1).tolist() == [level_count(int(c), 1) for c in counts]
    assert L.count_of(np.array([0]), 2).tolist() == [0]
