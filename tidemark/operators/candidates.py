"""Candidate sets and labels per hour and batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_hash
from tidemark.functions.splits import window_of_split
from tidemark.functions.vectors import author_or_unknown, count_or_zero
from tidemark.names import AUTHOR_IDX, EMB, HOUR, ITEM, NEG_HOUR, POST, PRIOR, SEED, TS, USER
from tidemark.plans.ordered import hash_bucket, with_position
from tidemark.plans.spread import dealt, spread_join
from tidemark.plans.topn import top_n_per_group

GROUP = ["split", HOUR, "batch_id"]
USER_HOUR = ["split", USER, HOUR]
NEGATIVE_SALTS = 16


def user_hours(likes: DataFrame) -> DataFrame:
    """The distinct (split, user, hour) of the likes."""
    return likes.select(*USER_HOUR).distinct()


def liked_lists(likes: DataFrame) -> DataFrame:
    """The liked posts of each user-hour as aligned lists, in time order.

    For output only: a row is as long as its user-hour.  Candidates and labels work on the
    likes themselves, a row each.
    """
    entry = F.struct(
        F.col(TS).alias("ts"),
        F.col(ITEM).alias("item"),
        F.col(EMB).alias("emb"),
        F.coalesce(PRIOR, F.lit(0)).alias("prior"),
        author_or_unknown(AUTHOR_IDX).alias("author"),
    )
    grouped = likes.groupBy(*USER_HOUR).agg(F.sort_array(F.collect_list(entry)).alias("liked"))

    def column(field: str, name: str) -> Column:
        return F.transform("liked", lambda e: e[field]).alias(name)

    return grouped.select(
        *USER_HOUR,
        column("item", "liked_post_ids"),
        column("emb", "liked_post_emb_indices"),
        column("prior", "liked_post_prior_cumulative_likes"),
        column("author", "liked_post_author_indices"),
    )


def assign_batches(
    hours: DataFrame, batch_size: int, shuffle: bool = True, drop_last: bool = False, seed: int = SEED, epoch: int = 0
) -> DataFrame:
    """Number the user-hours of each (split, hour) in batches of ``batch_size``.

    The order is a hash of the user, drawn anew per epoch when ``shuffle`` is set.
    Positions come from 256 hash buckets per hour, so that an hour with very many
    users is not sorted in one task.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    salt = f"batch:{epoch}" if shuffle else "batch"
    keyed = hours.withColumn("_order", seeded_hash(seed, salt, USER))
    placed = with_position(keyed, ["split", HOUR], ["_order", USER], "_position", hash_bucket("_order"))
    batched = placed.withColumn("batch_id", F.floor(F.col("_position") / batch_size).cast("long"))
    if drop_last:
        sizes = hours.groupBy("split", HOUR).agg(F.count(F.lit(1)).alias("_size"))
        full = F.floor(F.col("_size") / batch_size)
        batched = batched.join(sizes, ["split", HOUR]).where(F.col("batch_id") < full).drop("_size")
    return batched.drop("_order", "_position")


def batch_positives(batched: DataFrame, likes: DataFrame) -> DataFrame:
    """Distinct liked posts of each batch; the earliest like gives the attributes.

    ``likers`` are the users of the batch who liked the post: as many as a batch has users at most,
    however many likes a user-hour has.  A hot user-hour is parted in the join, and its posts
    spread over the groups.
    """
    rows = spread_join(likes, batched.select(*USER_HOUR, "batch_id"), USER_HOUR)
    earliest = F.struct(
        F.col(TS), F.col(EMB), F.coalesce(PRIOR, F.lit(0)).alias(PRIOR), author_or_unknown(AUTHOR_IDX).alias(AUTHOR_IDX)
    )
    posts = rows.groupBy(*GROUP, F.col(ITEM).alias("post_id")).agg(
        F.min(earliest).alias("first"), F.collect_set(USER).alias("likers")
    )
    return posts.select(
        *GROUP, "post_id", F.col(f"first.{EMB}"), F.col(f"first.{AUTHOR_IDX}"), count_or_zero(f"first.{PRIOR}").alias(PRIOR), "likers"
    )


def sampled_posts(posts: DataFrame) -> DataFrame:
    """Sampled negatives by window and hour."""
    author = author_or_unknown(AUTHOR_IDX) if AUTHOR_IDX in posts.columns else F.lit(1)
    return posts.where(F.col("in_random_sample") & F.col(NEG_HOUR).isNotNull()).select(
        F.col("split_window").alias("_window"),
        F.col(NEG_HOUR).alias(HOUR),
        F.col(POST).alias("post_id"),
        EMB,
        author.alias(AUTHOR_IDX),
        count_or_zero(PRIOR).alias(PRIOR),
    )


def batch_negatives(batches: DataFrame, posts: DataFrame) -> DataFrame:
    """The sampled posts of the hour for every batch of that hour.

    An hour with very many batches is spread: negatives are few per hour (the
    per-hour sample size), so they are copied to ``NEGATIVE_SALTS`` salts and each
    batch meets one copy.
    """
    salted_batches = batches.withColumns(
        {"_window": window_of_split("split"), "_salt": F.pmod(F.col("batch_id"), F.lit(NEGATIVE_SALTS)).cast("int")}
    )
    copies = sampled_posts(posts).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(NEGATIVE_SALTS - 1)))
    )
    return salted_batches.join(copies, ["_window", HOUR, "_salt"]).select(
        *GROUP, "post_id", EMB, AUTHOR_IDX, PRIOR
    )


def candidate_sets(
    batched: DataFrame,
    likes: DataFrame,
    posts: DataFrame,
    extra_negatives: int | None = None,
    seed: int = SEED,
    epoch: int = 0,
) -> DataFrame:
    """Candidates of each (split, hour, batch): liked posts first, then sampled ones.

    A post that is both keeps the attributes of the like.  ``extra_negatives``
    keeps that many sampled posts per batch, drawn by seed and epoch; liked posts
    are never dropped.  ``likers`` is null for the sampled ones.
    """
    liked = batch_positives(batched, likes)
    batches = batched.select(*GROUP).distinct()
    negatives = batch_negatives(batches, posts).join(liked.select(*GROUP, "post_id"), [*GROUP, "post_id"], "left_anti")
    if extra_negatives is not None:
        drawn = negatives.withColumn("_draw", seeded_hash(seed, f"extra:{epoch}", "split", "batch_id", "post_id"))
        negatives = top_n_per_group(drawn, GROUP, ["_draw", "post_id"], extra_negatives).drop("_draw")
    return liked.withColumn("from_likes", F.lit(True)).unionByName(
        negatives.withColumn("from_likes", F.lit(False)), allowMissingColumns=True
    )


def labelled_pairs(
    batched: DataFrame,
    candidates: DataFrame,
    keep: tuple[str, ...] = (),
    with_users: Callable[[DataFrame], DataFrame] = lambda users: users,
    with_candidates: Callable[[DataFrame], DataFrame] = lambda items: items,
) -> DataFrame:
    """Every user-hour against the candidates of its batch, with the label.

    Work is bounded by the batch: a group has at most ``batch_size`` users, and its
    candidates are their likes and the negatives of one hour.  The label comes from the
    likers on the candidate, so a pair costs a look at ``batch_size`` users at most and the
    pairs themselves are never shuffled.  Both sides come in a fixed number of parts, since the
    pairs of a part are sorted and are a batch size times as many as its rows.

    ``with_users`` and ``with_candidates`` add wide columns to a side after it was dealt, so that these are not
    shuffled; they keep the rows and the columns of ``GROUP``.
    """
    users = with_users(dealt(batched.select(*GROUP, USER, *keep), GROUP))
    label = F.coalesce(F.array_contains("likers", F.col(USER)), F.lit(False)).cast("int")
    return users.join(with_candidates(dealt(candidates, GROUP)), GROUP).withColumn("label", label).drop("likers")
