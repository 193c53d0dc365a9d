import os
import zlib

import numpy as np
import pytest
from cases import ROWS, empty, frame
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X
from tidemark.llm.queries import QUERIES

BIG = os.environ.get("TEST_TOXICITY_DIR", "/root/testdata/sf0.1")  # smaller ones have too few labels


def test_hidden_positives_are_found():
    """Positives among the unlabelled share a feature; plain learning would call them negative."""
    rng = np.random.default_rng(0)

    def text(toxic):
        words = rng.integers(100, 5000, 30)
        return np.unique(np.concatenate([words, rng.integers(0, 5, 2)]) if toxic else words)

    positive = [text(True) for _ in range(150)]
    hidden = [i < 150 for i in range(1000)]
    used, weights, bias = X.fit(positive, [text(h) for h in hidden], prior=0.15)
    table = dict(zip(used.tolist(), weights.tolist()))
    margin = lambda x: bias + sum(table.get(int(f), 0.0) for f in x)
    fresh = [(text(h), h) for h in [True] * 200 + [False] * 800]
    right = sum((margin(x) >= 0) == h for x, h in fresh)
    assert right >= 970


def risk(w, bias, positive, unlabelled, prior):
    """The non-negative risk, text by text."""
    loss = lambda texts, sign: np.mean([np.log1p(np.exp(-sign * (bias + sum(w[f] for f in x)))) for x in texts])
    return prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - prior * loss(positive, -1))


def test_descent_reaches_the_least_risk():
    """No small change of a weight or of the bias lowers the risk, and the risk is that of the definition."""
    rng = np.random.default_rng(3)
    positive = [rng.choice(6, 3, replace=False) for _ in range(40)]
    unlabelled = [rng.choice(6, 3, replace=False) if rng.random() < 0.3 else rng.choice(np.arange(2, 8), 3, replace=False) for _ in range(120)]
    rows = positive + unlabelled
    row, column = np.repeat(np.arange(len(rows)), 3), np.concatenate(rows)
    first = np.arange(len(rows)) < 40
    w, bias = X._descend(row, column, first, 0.3, np.zeros(8), 0.0, 0.0, 0.05)
    penalised = lambda w, b: risk(w, b, positive, unlabelled, 0.3) + 0.05 / 2 * (w**2).sum()
    least = penalised(w, bias)
    for k in range(8):
        for step in (-0.02, 0.02):
            moved = w.copy()
            moved[k] += step
            assert penalised(moved, bias) >= least - 1e-5
    assert min(penalised(w, bias + 0.02), penalised(w, bias - 0.02)) >= least - 1e-5


def test_share_of_a_mixture():
    rng = np.random.default_rng(4)
    for share in (0.02, 0.3, 0.8):
        known = rng.normal(2, 1, 500), rng.normal(-2, 1, 500)
        own = np.concatenate([rng.normal(2, 1, int(3000 * share)), rng.normal(-2, 1, int(3000 * (1 - share)))])
        assert abs(X.mixed_share(*known, own) - share) < 0.04


def test_near_copies_count_once():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, X.DIMENSIONS, 300)) for _ in range(50)]
    copies = [np.delete(b, rng.integers(len(b), size=5)) for b in base for _ in range(6)]
    assert len(X.without_near_copies(base)) == 50
    assert 50 <= len(X.without_near_copies(base + copies)) <= 55


@pytest.mark.parametrize("copies", [2, 15])
def test_more_toxic_documents_than_labels(spark, copies):
    """Unlabelled near copies of every toxic document: the labels' share is far from that of the documents."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    toxic = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id")
    number = F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("n")
    changed = F.concat(F.lit("Copy "), F.col("n"), F.lit(" of "), F.regexp_replace("text", "e([^e]*)$", "$1"))
    more = toxic.select("doc_id", "text", number).select((F.col("doc_id") + 10_000_000 * F.col("n")).alias("doc_id"), changed.alias("text"))
    scored = X.score(docs.unionByName(more), labels).where("held_out").select((F.col("doc_id") % 10_000_000).alias("doc_id"), "predicted")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in scored.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.8 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.03 * (counts[0, 0] + counts.get((0, 1), 0))


@pytest.mark.parametrize("positives,recall", [(100, 0.6), (350, 0.8)])
def test_few_labels(spark, positives, recall):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    few = labels.where((X.fold(F.col("doc_id"), 5) == 0) | (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) < positives * 1000 // 420))
    scored = X.score(docs, few).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in scored}
    assert counts[1, 1] >= recall * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.03 * (counts[0, 0] + counts.get((0, 1), 0))


def test_held_out(spark):
    scored = QUERIES["op1_toxicity"](spark, BIG).where("held_out")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = scored.join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    toxic = np.array([r["toxic"] for r in rows], bool)
    score = np.array([r["score"] for r in rows])
    assert toxic.sum() >= 5
    auc = np.mean((score[toxic][:, None] > score[~toxic]) + 0.5 * (score[toxic][:, None] == score[~toxic]))
    assert auc > 0.95
    predicted = score >= 0.5
    assert (predicted & toxic).sum() >= 0.8 * toxic.sum() and (predicted & ~toxic).sum() <= 0.03 * (~toxic).sum()
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    held = X.fold(F.col("doc_id"), 5) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    ours = {r["doc_id"]: r["score"] for r in X.score(docs, labels).collect()}
    theirs = {r["doc_id"]: r["score"] for r in X.score(docs, flipped).collect()}
    assert ours == theirs


def test_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = X.score(frame(spark, clash=("score", "key", "features")), labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((d is None, d) for d, _ in ROWS)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"]: r["held_out"] for r in got}
    assert all(h == (zlib.crc32(str("" if d is None else d).encode()) % 5 == 0) for d, h in held.items())
    blank = {r["score"] for r in got if r["doc_id"] in (2, 3, 4)}
    assert len(blank) == 1


def test_without_positives_every_score_is_alike(spark):
    labels = spark.createDataFrame([(5, 0), (6, 0)], "doc_id long, toxic int")
    assert len({r["score"] for r in X.score(frame(spark), labels).collect()}) == 1
    assert {r["predicted"] for r in X.score(frame(spark), labels.limit(0)).collect()} == {0}


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(empty(spark), labels).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").withColumn("score", F.lit(1))
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    marked = kept.join(labels, "doc_id").groupBy("toxic").count()
    all_ = {r["toxic"]: r["count"] for r in docs.join(labels, "doc_id").groupBy("toxic").count().collect()}
    left = {r["toxic"]: r["count"] for r in marked.collect()}
    assert left[0] >= 0.97 * all_[0] and left.get(1, 0) <= 0.15 * all_[1]
