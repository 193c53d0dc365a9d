"""User totals, eligibility and disjoint cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_hash
from tidemark.names import MIN_LIKES_PER_USER, SEED, USER
from tidemark.plans.durable import cut
from tidemark.plans.ordered import first_by_hash


def totals(likes: DataFrame) -> DataFrame:
    """Distinct users and rows.

    Users are counted over per-user counts, so the rows shrink before they move.
    """
    return likes_per_user(likes).agg(
        F.count(F.lit(1)).alias("n_users"), F.coalesce(F.sum("like_count"), F.lit(0)).alias("n_likes")
    )


def likes_per_user(likes: DataFrame) -> DataFrame:
    return likes.groupBy(USER).agg(F.count(F.lit(1)).alias("like_count"))


def eligible_users(likes: DataFrame, min_likes: int = MIN_LIKES_PER_USER) -> DataFrame:
    """Users with enough likes; a minimum of 0 keeps everybody."""
    counts = likes_per_user(likes)
    return counts.where(F.col("like_count") >= min_likes) if min_likes > 0 else counts


def capped_users(users: DataFrame, n: int | None, salt: str, seed: int = SEED) -> DataFrame:
    """The first ``n`` users in salted hash order; None keeps all, 0 or less none."""
    if n is None:
        return users
    if n <= 0:
        return users.limit(0)
    hashed = users.withColumn("_hash", seeded_hash(seed, salt, USER))
    return first_by_hash(hashed, n, "_hash", [USER]).drop("_hash")


def sample_cohorts(
    likes: DataFrame,
    min_likes: int = MIN_LIKES_PER_USER,
    max_trainval: int | None = None,
    max_unseen: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``(did, like_count, _user_cohort)``: two disjoint samples of eligible users.

    The counts are written once, so the likes are read once for both samples.
    """
    eligible = cut(eligible_users(likes, min_likes))
    trainval = capped_users(eligible, max_trainval, "trainval", seed)
    rest = eligible.join(trainval.select(USER), USER, "left_anti")
    unseen = capped_users(rest, max_unseen, "unseen_eval", seed)
    return trainval.withColumn("_user_cohort", F.lit("trainval")).unionByName(
        unseen.withColumn("_user_cohort", F.lit("unseen_eval"))
    )


def cohort_size_bound(max_trainval: int | None, max_unseen: int | None) -> int | None:
    """Most rows a cohort table can have, or None without caps."""
    if max_trainval is None or max_unseen is None:
        return None
    return max(max_trainval, 0) + max(max_unseen, 0)


def keep_members(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``members``; a semi join, no set on the driver."""
    return df.join(members.select(on).distinct(), on, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    return df.join(members.select(on).distinct(), on, "left_anti")


def user_is(cohort: str) -> Column:
    return F.col("_user_cohort") == cohort
