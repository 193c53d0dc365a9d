"""Scored candidate pairs of the core tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions.vectors import dot_score, summary_vector
from tidemark.operators import candidates as cand
from tidemark.operators.evaluation import total_likes
from tidemark.operators.history import listed_vectors
from tidemark.operators.ranking import ranking_rows
from tidemark.plans.durable import cut
from tidemark.plans.spread import lookup_join
from tidemark.queries import tables as t

KEYS = [*cand.GROUP, N.USER]
#: At most, of an embedding with its id in a broadcast table.
ROW_BYTES = 8 * t.DIM + 64


def batched(spark: SparkSession, sf: str) -> DataFrame:
    return cand.assign_batches(cand.user_hours(t.core(spark, sf).likes), t.BATCH)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled pairs with the history length and the like total of the user."""
    core = t.core(spark, sf)
    hours = batched(spark, sf)
    n_prior = F.least(F.size("prior_emb_indices"), F.lit(N.MAX_HISTORY_LEN)).alias("num_embedding_likes")
    described = hours.join(t.history(spark, sf).select(N.USER, N.HOUR, n_prior), [N.USER, N.HOUR]).join(
        total_likes(core.likes), N.USER
    )
    keep = ("num_embedding_likes", "num_total_likes")
    return cand.labelled_pairs(described, cand.candidate_sets(hours, core.likes, core.posts), keep)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs scored by the popularity of the candidate at the hour."""
    return pairs(spark, sf).withColumn("score", F.ln(F.lit(1.0) + F.col(N.PRIOR)))


def fresh_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking rows of the popularity scorer."""
    return ranking_rows(scored(spark, sf), KEYS, t.TOP_KS, extra=("num_embedding_likes", "num_total_likes"))


_rows: dict[tuple[str, str], DataFrame] = {}


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """The written ranking rows; evaluations start from them, once per session."""
    t.use_utc(spark)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _rows:
        _rows[key] = cut(fresh_rows(spark, sf))
    return _rows[key]


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with the history length and three scores: popularity, and the mean and the EMA history vector.

    Histories and candidates are dealt by batch with their ids and get their vectors there, the users after
    their summaries are made: where the embeddings can be sent to the tasks, no vector is shuffled.
    """
    core = t.core(spark, sf)
    hours = batched(spark, sf)
    recent = F.slice("prior_emb_indices", 1, N.MAX_HISTORY_LEN)
    n_prior = F.least(F.size("prior_emb_indices"), F.lit(N.MAX_HISTORY_LEN)).alias("num_embedding_likes")
    lists = t.history(spark, sf).select(N.USER, N.HOUR, recent.alias("prior_emb_indices"), n_prior)
    sets = cut(cand.candidate_sets(hours, core.likes, core.posts))

    def summarised(users: DataFrame) -> DataFrame:
        keys = [*KEYS, "num_embedding_likes"]
        return listed_vectors(users, core.embeddings, keys, N.MAX_HISTORY_LEN, ROW_BYTES).select(
            *keys,
            summary_vector("vectors", t.DIM, "mean").alias("mean_vector"),
            summary_vector("vectors", t.DIM, "ema").alias("ema_vector"),
        )

    def described(items: DataFrame) -> DataFrame:
        return lookup_join(items, core.embeddings.select(N.EMB, "embedding"), N.EMB, row_bytes=ROW_BYTES)

    pairs = cand.labelled_pairs(
        hours.join(lists, [N.USER, N.HOUR]), sets, ("prior_emb_indices", "num_embedding_likes"), summarised, described
    )
    return pairs.withColumns(
        {
            "popularity": F.ln(F.lit(1.0) + F.col(N.PRIOR)),
            "dot_mean": F.round(dot_score("mean_vector", "embedding", dim=t.DIM), 9),
            "dot_ema": F.round(dot_score("ema_vector", "embedding", dim=t.DIM), 9),
        }
    ).drop("mean_vector", "ema_vector", "embedding")
