"""User history at each like hour: what the user had liked before that hour began."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import age_seconds
from tidemark.names import AUTHOR_IDX, EMB, HOUR, PRIOR, TS, USER
from tidemark.operators.popularity import CURVE_HOUR
from tidemark.plans.asof import asof_backward
from tidemark.plans.durable import cut
from tidemark.plans.ordered import quantiles_of, ranked_counts, with_position
from tidemark.plans.spread import dealt, lookup_join, spread_join

LONG_LIST = 10_000


def longest_history(likes: DataFrame) -> int:
    """Length that leaves every history whole, from the largest like count.

    A history row holds a list, so a very long one draws a warning; ``max_prior``
    bounds it.
    """
    row = likes.groupBy(USER).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    longest = max(int(row.n or 1), 1)
    if longest > LONG_LIST:
        warnings.warn(f"histories of up to {longest} likes; max_prior bounds them", stacklevel=2)
    return longest


def prior_items(likes: DataFrame, max_prior: int, group: str = HOUR) -> DataFrame:
    """For every (user, group) the latest ``max_prior`` likes of strictly earlier groups.

    Returns ``(did, group, raw_prior_count, prior)`` where ``prior`` is a list of
    ``(ts, emb_idx, author_idx)``, newest first, ties by larger ``emb_idx``.

    A user's likes are numbered in time order and cut into pieces of ``max_prior``; an
    hour's last ``max_prior`` earlier likes lie in two neighbouring pieces.  Each piece goes
    into one row with the piece before it, so a row has at most ``2 * max_prior`` entries, an
    hour meets one row, and the pieces of a hot user are as many keys.
    """
    if AUTHOR_IDX not in likes.columns:
        likes = likes.withColumn(AUTHOR_IDX, F.lit(None).cast("long"))
    narrow = likes.select(USER, group, TS, EMB, AUTHOR_IDX)
    placed = cut(with_position(narrow, [USER], [group, TS, EMB, AUTHOR_IDX], "_at"))
    piece = F.floor(F.col("_at") / max_prior)
    rows = placed.withColumn("_piece", F.explode(F.array(piece, piece + 1)))
    pieces = rows.groupBy(USER, "_piece").agg(
        F.sort_array(F.collect_list(F.struct("_at", TS, EMB, AUTHOR_IDX)), asc=False).alias("_items")
    )
    before = F.col("raw_prior_count")
    hours = placed.groupBy(USER, group).agg(F.min("_at").alias("raw_prior_count"))
    hours = hours.withColumn("_piece", F.floor(F.greatest(before - 1, F.lit(0)) / max_prior))
    # Positions fall by one along the row, so the newest earlier like is found by its distance.
    start = F.col("_items")[0]["_at"] - before + 2
    recent = F.slice("_items", start.cast("int"), F.least(before, F.lit(max_prior)).cast("int"))
    entries = F.transform(recent, lambda e: F.struct(e[TS].alias(TS), e[EMB].alias(EMB), e[AUTHOR_IDX].alias(AUTHOR_IDX)))
    return hours.join(pieces, [USER, "_piece"]).select(USER, group, before, entries.alias("prior"))


def user_history(
    likes: DataFrame, curve: DataFrame, max_prior: int | None = None, with_authors: bool = True
) -> DataFrame:
    """One row per (user, like hour) with aligned lists, newest first.

    Popularity is taken at the target hour.  The distinct (post, hour) pairs of
    all lists are looked up once and joined back to the list entries, hot pairs parted.
    """
    if max_prior is None or max_prior <= 0:
        max_prior = longest_history(likes)
    prior = cut(prior_items(likes, max_prior))  # read for the lookup and for the join
    entries = prior.select(USER, HOUR, "raw_prior_count", F.posexplode_outer("prior").alias("pos", "item")).select(
        USER, HOUR, "raw_prior_count", "pos", "item.*"
    )
    needed = entries.where(F.col("pos").isNotNull()).select(EMB, HOUR)
    lookup = asof_backward(needed, curve, EMB, HOUR, CURVE_HOUR, PRIOR)
    filled = spread_join(entries, lookup, [EMB, HOUR], "left")
    entry = F.struct(
        "pos",
        F.col(EMB).alias("emb"),
        (age_seconds(HOUR, TS) / F.lit(3600.0)).cast("float").alias("age"),
        F.coalesce(PRIOR, F.lit(0)).alias("count"),
        F.col(AUTHOR_IDX).alias("author"),
    )
    grouped = filled.groupBy(USER, HOUR).agg(
        F.first("raw_prior_count").alias("raw_prior_count"),
        # At most max_prior entries per row.
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), entry))).alias("_list"),
    )

    def column(field: str) -> Column:
        return F.transform("_list", lambda e: e[field])

    out = grouped.select(
        USER,
        HOUR,
        column("emb").alias("prior_emb_indices"),
        column("age").alias("prior_like_age_hours_at_bucket_start"),
        column("count").alias(PRIOR),
        column("author").alias("prior_author_indices"),
        "raw_prior_count",
    )
    return out if with_authors else out.drop("prior_author_indices")


def history_vectors(history: DataFrame, embeddings: DataFrame, max_len: int) -> DataFrame:
    """``(did, like_hour_bucket, vectors)`` of the newest ``max_len`` history posts.

    The lists of ids are dealt by user and hour before they get their vectors, in parts that stay as many
    as they are: where the embeddings are small enough to be sent to the tasks, no vector is shuffled.
    """
    return listed_vectors(dealt(history, [USER, HOUR]), embeddings, [USER, HOUR], max_len)


def listed_vectors(
    rows: DataFrame, embeddings: DataFrame, keys: Sequence[str], max_len: int, row_bytes: int | None = None
) -> DataFrame:
    """``(keys, vectors)`` of the first ``max_len`` ids of ``prior_emb_indices`` in each row; ``keys`` tell rows apart.

    Rows that come dealt by some of the keys keep their places where the embeddings are sent to the tasks: always
    for a hinted table, and up to the broadcast limit where ``row_bytes`` is given.
    """
    entries = rows.select(*keys, F.posexplode_outer(F.slice("prior_emb_indices", 1, max_len)).alias("pos", EMB))
    joined = lookup_join(entries, embeddings.select(EMB, "embedding"), EMB, "left", row_bytes)
    return (
        joined.groupBy(*keys)
        # At most max_len vectors per row.
        .agg(F.sort_array(F.collect_list(F.when(F.col("embedding").isNotNull(), F.struct("pos", "embedding")))).alias("l"))
        .select(*keys, F.transform("l", lambda e: e["embedding"]).alias("vectors"))
    )


def last_history_lengths(history: DataFrame) -> DataFrame:
    """Raw history length of each user at their last hour."""
    return history.groupBy(USER).agg(F.max_by("raw_prior_count", HOUR).alias("history_len"))


QUANTILES = {"p25": 0.25, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def history_distribution(history: DataFrame, max_prior: int) -> DataFrame:
    """Spread of last-hour history lengths before and after the cap."""
    lengths = last_history_lengths(history)
    both = lengths.select(
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("stage"), F.col("history_len")),
                F.struct(F.lit("after").alias("stage"), F.least("history_len", F.lit(max_prior)).alias("history_len")),
            )
        ).alias("r")
    ).select("r.*")
    spread = both.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("history_len").alias("mean"),
        F.min("history_len").alias("min"),
        F.max("history_len").alias("max"),
        F.count_if(F.col("history_len") > max_prior).alias("n_users_capped"),
        F.sum(F.greatest(F.col("history_len") - max_prior, F.lit(0))).alias("n_likes_dropped"),
    )
    ranked = ranked_counts(both, ["stage"], "history_len")
    median = quantiles_of(ranked, ["stage"], "history_len", {"median": 0.5})
    nearest = quantiles_of(ranked, ["stage"], "history_len", QUANTILES, nearest=True)
    return spread.join(median, "stage").join(nearest, "stage")


def history_summary(history: DataFrame) -> DataFrame:
    """How many rows have a history and how long it is."""
    n = F.size("prior_emb_indices")
    return history.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(n > 0).alias("n_with_history"),
        F.count_if(n == 0).alias("n_empty_history"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_prior"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_prior"),
        F.coalesce(F.min(F.when(n > 0, n)), F.lit(0)).alias("min_prior"),
    )
