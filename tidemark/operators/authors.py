"""Author support and author ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.names import AUTHOR, AUTHOR_IDX, FIRST_AUTHOR, MIN_AUTHOR_SUPPORT, USER
from tidemark.plans.durable import cut
from tidemark.plans.spread import spread_join
from tidemark.sources.embeddings import dense_ids


def author_exposures(posts: DataFrame, likes: DataFrame) -> DataFrame:
    """Train-window exposures per author: sampled rows and train likes.

    Both sides are counted before they are put together.
    """
    sampled = posts.where(F.col("in_random_sample") & (F.col("split_window") == "train")).select(
        F.col(USER).alias(AUTHOR), F.lit(1).alias("n_sampled"), F.lit(0).alias("n_liked")
    )
    liked = likes.where(F.col("split") == "train").select(
        AUTHOR, F.lit(0).alias("n_sampled"), F.lit(1).alias("n_liked")
    )
    return (
        sampled.unionByName(liked)
        .groupBy(AUTHOR)
        .agg(F.sum("n_sampled").alias("n_sampled"), F.sum("n_liked").alias("n_liked"))
    )


def author_index(posts: DataFrame, likes: DataFrame, min_support: int = MIN_AUTHOR_SUPPORT) -> DataFrame:
    """``(author_did, author_train_count, author_idx)``; ids from 2 in name order."""
    supported = (
        author_exposures(posts, likes)
        .select(AUTHOR, (F.col("n_sampled") + F.col("n_liked")).alias("author_train_count"))
        .where(F.col(AUTHOR).isNotNull() & (F.col("author_train_count") >= min_support))
    )
    supported = cut(supported)  # read for the ids and for the join
    return supported.join(dense_ids(supported, AUTHOR, AUTHOR_IDX, FIRST_AUTHOR), AUTHOR)


def author_stats(posts: DataFrame, likes: DataFrame, min_support: int = MIN_AUTHOR_SUPPORT) -> DataFrame:
    """Exposure and author totals behind the index."""
    total = F.col("n_sampled") + F.col("n_liked")
    return author_exposures(posts, likes).agg(
        F.coalesce(F.sum("n_sampled"), F.lit(0)).alias("n_author_random_train_exposures"),
        F.coalesce(F.sum("n_liked"), F.lit(0)).alias("n_author_like_train_exposures"),
        F.coalesce(F.sum(total), F.lit(0)).alias("n_author_train_exposures"),
        F.count(F.lit(1)).alias("n_authors_with_train_support"),
        F.count_if(F.col(AUTHOR).isNotNull() & (total >= min_support)).alias("n_authors_indexed"),
    )


def with_author_idx(df: DataFrame, index: DataFrame, on: str = AUTHOR) -> DataFrame:
    """Add the author id, null for authors below the support; hot authors are parted."""
    lookup = index.select(F.col(AUTHOR).alias(on), AUTHOR_IDX)
    return spread_join(df, lookup, on, "left")


def author_table_size(index: DataFrame, column: str = AUTHOR_IDX) -> DataFrame:
    """Rows an author table needs: the largest id plus one, at least two."""
    top = F.max(column)
    checked = F.when(top < 1, F.raise_error(F.lit("author ids must be at least 1")).cast("int")).otherwise(top)
    return index.agg(F.greatest(F.coalesce(checked + 1, F.lit(2)), F.lit(2)).alias("n_author_rows"))
