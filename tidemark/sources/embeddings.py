"""The embedding table: one valid vector per post, densely numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import decode_vector
from tidemark.functions.vectors import pick_embedding
from tidemark.names import EMB, EMBED_DIMS, POST, TS
from tidemark.plans.ordered import with_position
from tidemark.plans.scalars import row_of
from tidemark.plans.spread import semi_join_spread
from tidemark.plans.topn import one_per_key


def known_dim(model: str) -> int:
    if model not in EMBED_DIMS:
        raise ValueError(f"unknown embedding model {model!r}; known: {', '.join(sorted(EMBED_DIMS))}")
    return EMBED_DIMS[model]


def first_dim(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Length of one non-null vector, as a one-row table."""
    return vectors.where(F.col(column).isNotNull()).select(F.size(column).alias("dim")).limit(1)


def raw_vector(model: str, column: str = "embeddings") -> Column:
    """Vector of the model out of the raw ``{key, value}`` list."""
    return decode_vector(pick_embedding(column, model))


def dense_ids(keys: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """Consecutive 64-bit ids of distinct keys in key order, by one range exchange."""
    numbered = with_position(keys.select(key).distinct(), [], [key], name)
    return numbered.withColumn(name, F.col(name) + F.lit(start).cast("long"))


def candidate_vectors(posts: DataFrame, candidates: DataFrame, vector: Column) -> DataFrame:
    """``(at_uri, record_created_at, embedding)`` of the raw posts that are candidates.

    The semi join runs before the vector is decoded, so only candidates pay.
    """
    return semi_join_spread(posts, candidates, POST).select(POST, TS, vector.alias("embedding"))


def _state(dim: int) -> Column:
    return (
        F.when(F.col("embedding").isNull(), "null")
        .when(F.size("embedding") != dim, "wrong_dim")
        .otherwise("valid")
    )


def first_valid(vectors: DataFrame, dim: int) -> DataFrame:
    """One vector per post: the earliest row whose vector has the right length."""
    valid = vectors.where(_state(dim) == "valid")
    return one_per_key(valid, [POST], [F.col(TS), F.col("embedding")]).select(POST, "embedding")


def numbered(first: DataFrame) -> DataFrame:
    """``(at_uri, emb_idx, embedding)`` with ids by address.

    Ids are drawn on the addresses alone; the vectors are joined on afterwards, so
    that no wide row takes part in the ordering.
    """
    return dense_ids(first, POST, EMB).join(first, POST).select(POST, EMB, "embedding")


def embedding_table(vectors: DataFrame, dim: int) -> DataFrame:
    """The numbered table of first valid vectors."""
    return numbered(first_valid(vectors, dim))


def embedding_stats(vectors: DataFrame, candidates: DataFrame, dim: int) -> DataFrame:
    """Counts of valid vectors and of each reason to drop one."""
    per_post = (
        vectors.select(POST, _state(dim).alias("state"))
        .groupBy(POST)
        .agg(
            F.count_if(F.col("state") == "null").alias("n_null"),
            F.count_if(F.col("state") == "wrong_dim").alias("n_wrong"),
            F.count_if(F.col("state") == "valid").alias("n_valid"),
        )
    )
    scanned = per_post.agg(
        F.coalesce(F.count_if(F.col("n_valid") > 0), F.lit(0)).alias("n_embeddings_valid"),
        F.coalesce(F.sum("n_null"), F.lit(0)).alias("n_embeddings_null"),
        F.coalesce(F.sum("n_wrong"), F.lit(0)).alias("n_embeddings_wrong_dim"),
        F.coalesce(F.sum(F.greatest(F.col("n_valid") - 1, F.lit(0))), F.lit(0)).alias("n_embeddings_duplicate_uri"),
    )
    per_candidate = candidates.groupBy(POST).agg(F.count(F.lit(1)).alias("n"))
    wanted = per_candidate.agg(
        F.sum("n").alias("n_posts_candidate"), F.count(F.lit(1)).alias("n_posts_candidate_unique")
    )
    return scanned.withColumn("_wanted", row_of(wanted)).select(
        "_wanted.*",
        "n_embeddings_valid",
        "n_embeddings_null",
        "n_embeddings_wrong_dim",
        "n_embeddings_duplicate_uri",
        (F.col("_wanted.n_posts_candidate_unique") - F.col("n_embeddings_valid")).alias("n_posts_dropped_no_embedding"),
    )


def require_embeddings(table: DataFrame) -> DataFrame:
    """Fail when there is no valid vector at all."""
    if not table.limit(1).count():
        raise ValueError("no valid embeddings found")
    return table
