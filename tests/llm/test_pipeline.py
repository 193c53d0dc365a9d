"""The pipeline against brute-force versions of its stages, and its queries against their SQL."""

import re
import time

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import SF_DIR
from check_queries import TABLES, normalised
from pyspark.sql import functions as F
from test_decontamination import brute as contaminated
from test_near_copies import brute as unlike_texts
from test_packing import checked
from test_pii import PLAIN, brute as personal

import __spark_entry__ as entry_module
from tidemark.llm import near_copies, toxicity, words
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF_DIR).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalised(got) == normalised(want)


def test_registered():
    names = entry_module.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        out.append(docs)
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(spark, stages):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for stage in stages[:-1]:
        assert stage.schema.simpleString() == docs.schema.simpleString()


def test_stages(spark, stages):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    toxic, unlike, clean, masked = (rows_of(s) for s in stages[:-1])
    assert set(toxic) == {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 0").collect()}
    assert sorted(unlike, key=repr) == unlike_texts([(d, r["text"]) for d, r in toxic.items()])
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    judged = contaminated([(d, r["text"]) for d, r in unlike.items()], bench)
    assert set(clean) == {d for d, *_, bad in judged if not bad}
    assert set(clean) < set(unlike) < set(toxic)
    assert set(masked) == set(clean)
    for doc, row in masked.items():
        before = personal(clean[doc]["text"])
        if not any(before.values()):
            continue
        assert sum(row["text"].count(f"[{k.upper()}]") for k in PLAIN) >= max(len(s) for s in before.values())
        assert not any(personal(row["text"]).values())
        assert row["n_chars"] == len(row["text"])


def test_packing_of_the_rest(spark, stages):
    kept = rows_of(stages[-2])
    sizes = {d: len((r["text"] or "").encode().split()) + 1 for d, r in kept.items()}
    sources = {d: r["source"] for d, r in kept.items()}
    checked(stages[-1].collect(), sizes, 2048, sources, dict.fromkeys(kept))


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    want = stages[-1].groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_batches_are_bounded(spark):
    """Long texts do not make long Arrow batches: executors hold several of each task."""
    spark.conf.unset(corpus_pipeline.BATCH_CONF)
    docs = spark.range(0, 8000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    try:
        corpus_pipeline.decontaminate(spark, docs, SF_DIR)
        found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(found) > 1 and max(found) <= corpus_pipeline.BATCH_BYTES + (1 << 20)
        spark.conf.set(corpus_pipeline.BATCH_CONF, "1m")  # what the session asks for stays
        corpus_pipeline.decontaminate(spark, docs, SF_DIR)
        assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) <= 2 << 20
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_CONF)


def test_distinct():
    assert words.distinct(np.array([5, 1, 5, 0], np.int64)).tolist() == [0, 1, 5]
    assert words.distinct(np.zeros(0, np.uint64)).tolist() == []


def test_features_cost_little_beside_their_words():
    """Features and shingles are told apart by sorting; hashing took many times as long and a set of all of them."""
    text = " ".join(map(str, np.random.default_rng(2).integers(10**9, 10**10, 100_000).tolist()))
    data, edges = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    weights = toxicity.Weights(np.ones(toxicity.DIMENSIONS), 0.0)
    made, kept, sets = [], [], []
    for _ in range(3):
        times = [time.process_time()]
        list(toxicity.features(data, edges))
        times.append(time.process_time())
        toxicity.margins(data, edges, weights)
        times.append(time.process_time())
        list(near_copies.shingle_sets(data, edges))
        times.append(time.process_time())
        for spent, a, b in zip((made, kept, sets), times, times[1:]):
            spent.append(b - a)
    assert min(kept) < 3 * min(made) and min(sets) < min(made)
