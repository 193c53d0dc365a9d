"""Candidate counts, hourly counts, exact prior popularity and the popularity curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hashing import candidate_sample
from tidemark.functions.times import hour_bucket
from tidemark.names import (
    EMB,
    HOUR,
    ITEM,
    MIN_LIKES_PER_NEGATIVE,
    NEG_HOUR,
    NEGATIVE_SAMPLE_PCT,
    POST,
    PRIOR,
    SEED,
    TS,
)
from tidemark.plans.asof import asof_backward
from tidemark.plans.spread import spread_join

CURVE_HOUR = "popularity_hour_bucket"
TARGET_HOUR = "target_hour"


def hourly_likes(likes: DataFrame, key: str = ITEM) -> DataFrame:
    """Likes per post and hour; only hours with likes have a row.

    Hot posts shrink to one row per hour in the map tasks already.  Candidate
    counts, prior popularity and the curve all follow from this table, so a run
    writes it once and reads the likes once for the three.
    """
    return likes.groupBy(key, hour_bucket(TS).alias("like_hour")).agg(F.count(F.lit(1)).alias("likes_this_hour"))


def sampled_like_counts(likes: DataFrame, share: float = NEGATIVE_SAMPLE_PCT, seed: int = SEED) -> DataFrame:
    """Global like count of a hash sample of the posts, from likes or hourly likes."""
    kept = likes.where(candidate_sample(ITEM, share, seed))
    count = F.sum("likes_this_hour") if "likes_this_hour" in likes.columns else F.count(F.lit(1))
    return kept.groupBy(ITEM).agg(count.alias("global_like_count"))


def candidate_counts(
    likes: DataFrame,
    share: float = NEGATIVE_SAMPLE_PCT,
    min_likes: int = MIN_LIKES_PER_NEGATIVE,
    seed: int = SEED,
) -> DataFrame:
    """Sampled posts with enough likes to serve as negatives."""
    return sampled_like_counts(likes, share, seed).where(F.col("global_like_count") >= min_likes)


def candidate_stats(counts: DataFrame, min_likes: int = MIN_LIKES_PER_NEGATIVE) -> DataFrame:
    """Posts and likes before and after the minimum."""
    enough = F.col("global_like_count") >= min_likes
    return counts.agg(
        F.count(F.lit(1)).alias("n_posts_before_min"),
        F.coalesce(F.sum("global_like_count"), F.lit(0)).alias("n_likes_before_min"),
        F.count_if(enough).alias("n_posts"),
        F.coalesce(F.sum(F.when(enough, F.col("global_like_count"))), F.lit(0)).alias("n_likes"),
    )


def cumulative_curve(hourly: DataFrame, key: str = ITEM) -> DataFrame:
    """Likes up to the end of each hour, keyed by the hour from which they count.

    A group has at most one row per hour, so the window stays small for any post.
    """
    so_far = Window.partitionBy(key).orderBy("like_hour").rowsBetween(Window.unboundedPreceding, 0)
    return hourly.select(
        key,
        (F.col("like_hour") + F.expr("INTERVAL 1 HOUR")).alias(CURVE_HOUR),
        F.sum("likes_this_hour").over(so_far).alias(PRIOR),
    )


def needed_post_hours(likes: DataFrame, posts: DataFrame) -> DataFrame:
    """Distinct (post, hour) pairs of the likes and of the sampled negatives."""
    positive = likes.select(ITEM, F.col(HOUR).alias(TARGET_HOUR))
    negative = posts.where(F.col("in_random_sample") & F.col(NEG_HOUR).isNotNull()).select(
        F.col(POST).alias(ITEM), F.col(NEG_HOUR).alias(TARGET_HOUR)
    )
    return positive.unionByName(negative).distinct()


def prior_popularity(hourly: DataFrame, needed: DataFrame) -> DataFrame:
    """Likes strictly before the hour for every needed (post, hour) pair.

    ``hourly`` comes from :func:`hourly_likes`: a hot post enters the join as a few
    rows, not with all its likes.
    """
    curve = cumulative_curve(hourly.join(needed.select(ITEM).distinct(), ITEM, "left_semi"))
    return asof_backward(needed, curve, ITEM, TARGET_HOUR, CURVE_HOUR, PRIOR)


def with_prior_on_likes(likes: DataFrame, prior: DataFrame) -> DataFrame:
    """Likes with the count of their post at their hour, 0 when unknown; hot (post, hour) pairs are parted."""
    joined = spread_join(likes, prior.withColumnRenamed(TARGET_HOUR, HOUR), [ITEM, HOUR], "left")
    return joined.withColumn(PRIOR, F.coalesce(PRIOR, F.lit(0)))


def with_prior_on_posts(posts: DataFrame, prior: DataFrame) -> DataFrame:
    """Sampled rows get a count, 0 when unknown; liked-only rows stay null."""
    renamed = prior.withColumnsRenamed({ITEM: POST, TARGET_HOUR: NEG_HOUR})
    joined = posts.join(renamed, [POST, NEG_HOUR], "left")
    return joined.withColumn(PRIOR, F.when(F.col("in_random_sample"), F.coalesce(PRIOR, F.lit(0))))


def popularity_curve(hourly: DataFrame, liked_posts: DataFrame) -> DataFrame:
    """``(emb_idx, popularity_hour_bucket, prior_cumulative_likes)`` of liked posts.

    ``liked_posts`` maps each post to its ``emb_idx``.
    """
    per_post = hourly.join(liked_posts.select(ITEM, EMB), ITEM)
    per_id = per_post.groupBy(EMB, "like_hour").agg(F.sum("likes_this_hour").alias("likes_this_hour"))
    return cumulative_curve(per_id, EMB)
