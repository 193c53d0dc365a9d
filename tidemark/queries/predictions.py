"""A prediction table over the likes: a hashed truth and a hashed probability per like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions.hashing import leading_number, seeded_hash, uniform
from tidemark.operators.likes import like_positions
from tidemark.plans.durable import cut
from tidemark.queries import tables as t


_written: dict[tuple[str, str], DataFrame] = {}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``(did, post_id, y_true, y_pred_proba, num_embedding_likes)``, one row per like.

    Evaluations start from the written table, made once per session.
    """
    t.use_utc(spark)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        _written[key] = cut(_predict(spark, sf))
    return _written[key]


def _predict(spark: SparkSession, sf: str) -> DataFrame:
    placed = like_positions(t.raw_likes(spark, sf))
    return placed.select(
        N.USER,
        F.col(N.ITEM).alias("post_id"),
        (leading_number(seeded_hash(42, "truth", N.USER, N.ITEM)).cast("long") % 2).alias("y_true"),
        uniform(seeded_hash(42, "proba", N.USER, N.ITEM)).alias("y_pred_proba"),
        (F.col("like_order") - 1).alias("num_embedding_likes"),
    )
