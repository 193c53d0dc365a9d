"""A corpus in five stages: toxic documents go, near copies go, benchmark passages go, personal data is masked, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, near_copies, packing, pii, toxicity
from tidemark.llm.rows import documents
from tidemark.plans.durable import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Most bytes of an Arrow batch.  Spark cuts batches by rows and at 64 MB, and the JVM, the pipe and Python hold several of each task.
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(stage: Stage) -> Stage:
    """The stage with Arrow batches of at most :data:`BATCH_BYTES` in its session, unless that sets a bound of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_CONF, None) is None:
            spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
        return stage(spark, docs, sf_dir)

    return run


@bounded_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@bounded_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash, then an exact check; five-word shingles, similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs)


@bounded_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded_batches
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; every document stays."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@bounded_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("personal data", mask_personal_data),
    ("best-fit packing", pack),
]

#: The stages learn models and pack in an order that SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
