"""Positive pairs with features and, per user, as many negatives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import leading_number, seeded_hash
from tidemark.names import ITEM, POST, SEED, USER
from tidemark.plans.durable import cut
from tidemark.plans.ordered import with_position
from tidemark.plans.spread import semi_join_spread, spread_join
from tidemark.sources.embeddings import dense_ids

ROUNDS = 4
#: Steps of a walk back into range.  Below 4,096 numbers this is always enough; above, a
#: place is lost with a chance of 64 ** -64 at most.
WALKS = 64


def distinct_likes(likes: DataFrame, posts: DataFrame) -> DataFrame:
    """Distinct (user, post) pairs whose post has features; hot posts are parted."""
    named = likes.select(USER, F.col(ITEM).alias(POST))
    return semi_join_spread(named.distinct(), posts, POST, named)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shuffled_place(place: Column, n: Column, key: Column | str, seed: int = SEED) -> Column:
    """Where ``place`` goes in a permutation of ``0 .. n-1`` that belongs to ``key`` alone.

    A Feistel network: the number is a cell of a grid with ``rows * columns >= n`` cells, and in
    turns the row moves by a hash of the column and the column by a hash of the row.
    Cells beyond ``n`` are permuted on until they fall below it (cycle walking).  A null after
    ``WALKS`` steps.
    """
    columns = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    rows = F.floor((n + columns - 1) / columns).cast("long")

    def moved(at: Column, size: Column, other: Column, step: int) -> Column:
        return F.pmod(at + leading_number(seeded_hash(seed, f"place{step}", key, other)).cast("long"), size)

    def permuted(cell: Column) -> Column:
        def turn(row: Column, column: Column, step: int) -> Column:
            if step == ROUNDS:
                return row * columns + column
            if step % 2 == 0:
                return _let(moved(row, rows, column, step), lambda r: turn(r, column, step + 1))
            return _let(moved(column, columns, row, step), lambda c: turn(row, c, step + 1))

        return turn(F.floor(cell / columns), F.pmod(cell, columns), 0)

    first = permuted(place.cast("long"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(v < n, v).otherwise(permuted(v)))
    return _let(last, lambda v: F.when(v < n, v))


def negative_pairs(likes: DataFrame, posts: DataFrame, seed: int = SEED) -> DataFrame:
    """Per user as many random unliked posts as liked ones, or all there are.

    Posts are numbered ``0 .. n-1`` and each user goes through them in a permutation of
    their own.  Among the first ``2k`` stops of a user with ``k`` likes at most ``k`` are
    liked, so the first ``k`` unliked stops exist unless the posts run out.  Each like makes
    two stops, so the work follows the likes, no user is crossed with all posts, and a
    user with very many likes is made in many tasks.
    """
    positives = cut(distinct_likes(likes, posts))
    numbered = cut(dense_ids(posts, POST, "post_no"))
    n_posts = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_user = positives.groupBy(USER).agg(F.count(F.lit(1)).alias("k"))

    placed = with_position(positives, [USER], [POST], "j")
    stops = (
        spread_join(placed, per_user, USER, measured=positives)
        .withColumn("_n", n_posts)
        .withColumn("i", F.explode(F.array(F.col("j") * 2, F.col("j") * 2 + 1)))
        .where(F.col("i") < F.col("_n"))
        .select(USER, "k", "i", shuffled_place(F.col("i"), F.col("_n"), USER, seed).alias("post_no"))
    )
    unliked = stops.join(numbered, "post_no").join(positives, [USER, POST], "left_anti")
    ranked = with_position(unliked, [USER], ["i"], "_taken")
    return ranked.where(F.col("_taken") < F.col("k")).select(USER, POST)


def pairs_dataset(likes: DataFrame, posts: DataFrame, seed: int = SEED) -> DataFrame:
    """Positives (every like row) and sampled negatives with the features of the post; hot posts are parted."""
    named = likes.select(USER, F.col(ITEM).alias(POST))
    negatives = negative_pairs(likes, posts, seed).withColumn("liked", F.lit(0))
    return spread_join(named.withColumn("liked", F.lit(1)).unionByName(negatives), posts, POST, measured=named)
