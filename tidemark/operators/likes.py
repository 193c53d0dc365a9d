"""The likes core table: sampled users, labelled splits, capped likes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_hash
from tidemark.functions.splits import Windows, like_split
from tidemark.functions.times import hour_bucket, time_literal
from tidemark.names import HOUR, ITEM, MAX_LIKES_PER_USER, MIN_LIKES_PER_USER, SEED, TS, USER
from tidemark.operators.cohorts import eligible_users, keep_members, user_is
from tidemark.plans.ordered import with_position
from tidemark.plans.sizes import broadcast_if_bounded
from tidemark.plans.spread import semi_join_spread
from tidemark.plans.topn import salt_of, top_n_per_group

COHORT_ROW_BYTES = 120


def likes_of_cohorts(
    likes: DataFrame, cohorts: DataFrame, max_users: int | None = None, how: str = "inner"
) -> DataFrame:
    """Likes of the sampled users with cohort and like count (``left``: all likes, nulls for other users).

    ``max_users`` is the bound that the cohort caps imply; when it is small enough
    the likes are joined in place, without a shuffle.
    """
    small, _ = broadcast_if_bounded(cohorts, max_users, COHORT_ROW_BYTES)
    return likes.join(small, USER, how)


def in_cohort_window(windows: Windows) -> Column:
    """Train and later likes of seen users, val and later likes of unseen users."""
    ts = F.col(TS)
    keep = (user_is("trainval") & (ts >= time_literal(windows.train_start))) | (
        user_is("unseen_eval") & (ts >= time_literal(windows.val_start))
    )
    return keep if windows.holdout_end is None else keep & (ts < time_literal(windows.holdout_end))


def cohort_window(likes: DataFrame, windows: Windows) -> DataFrame:
    """The likes inside the window of their user's cohort."""
    return likes.where(in_cohort_window(windows))


def split_or_error(likes: DataFrame) -> DataFrame:
    """Fail in the job when a like has no split."""
    return likes.withColumn(
        "split",
        F.coalesce("split", F.raise_error(F.lit("found a like with null split after split labelling")).cast("string")),
    )


def random_cap(
    likes: DataFrame, max_likes: int = MAX_LIKES_PER_USER, seed: int = SEED
) -> DataFrame:
    """At most ``max_likes`` likes per user in hash order; repeated likes use up the cap.

    Ranks are salted: a user's likes are first cut in parts, however many there are.
    """
    if max_likes <= 0:
        return likes
    keyed = likes.withColumn("_rand", seeded_hash(seed, "cap", USER, ITEM))
    return top_n_per_group(keyed, [USER], ["_rand", ITEM, TS], max_likes, salt_of(ITEM, TS)).drop("_rand")


def recency_cap(likes: DataFrame, max_likes: int = MAX_LIKES_PER_USER) -> DataFrame:
    """The latest ``max_likes`` likes of each user; ranks are salted."""
    if max_likes <= 0:
        return likes
    return top_n_per_group(likes, [USER], [F.col(TS).desc(), ITEM], max_likes, salt_of(ITEM, TS))


def likes_core(
    likes: DataFrame,
    cohorts: DataFrame,
    windows: Windows,
    max_likes: int = MAX_LIKES_PER_USER,
    seed: int = SEED,
    max_users: int | None = None,
) -> DataFrame:
    """Windowed, labelled, capped and distinct likes of the sampled users."""
    sampled = cohort_window(likes_of_cohorts(likes, cohorts, max_users), windows)
    labelled = split_or_error(sampled.withColumn("split", like_split("_user_cohort", TS, windows)))
    return (
        random_cap(labelled, max_likes, seed)
        .select(USER, ITEM, TS, "split")
        .distinct()
        .withColumn(HOUR, hour_bucket(TS))
    )


def reverify(
    likes: DataFrame, posts: DataFrame, min_likes: int = MIN_LIKES_PER_USER, measured: DataFrame | None = None
) -> DataFrame:
    """Drop likes whose post is gone, then users who fell below the minimum.

    Hot posts are parted; ``measured`` may be a written table with the same posts.
    """
    joined = semi_join_spread(likes, posts.select(F.col("at_uri").alias(ITEM)), ITEM, measured)
    if min_likes <= 0:
        return joined
    return keep_members(joined, eligible_users(joined, min_likes), USER)


def like_positions(likes: DataFrame) -> DataFrame:
    """Which like of the user each row is, by time; a hot user, or a hot day of one, is cut into parts."""
    placed = with_position(likes, [USER], [TS, ITEM], "like_order")
    return placed.withColumn("like_order", F.col("like_order") + 1)
