"""The posts core table: hourly weighted negatives and liked posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import candidate_sample, sample_score, seeded_hash, uniform
from tidemark.functions.splits import Windows, post_split_window
from tidemark.functions.times import hour_bucket, time_literal
from tidemark.names import ELIGIBLE_HOURS, ITEM, NEG_HOUR, NEGATIVE_ALPHA, NEGATIVES_PER_HOUR, POST, SEED, TS, USER
from tidemark.plans.durable import cut
from tidemark.plans.spread import semi_join_spread
from tidemark.plans.topn import one_per_key, salt_of, top_n_per_group

META = [POST, TS, USER, "record_text"]
HOUR_TEXT = "yyyy-MM-dd HH:mm:ss"


def post_window(posts: DataFrame, windows: Windows) -> DataFrame:
    """Posts created inside ``[train_start, holdout_end)``."""
    kept = posts.where(F.col(TS) >= time_literal(windows.train_start))
    if windows.holdout_end is not None:
        kept = kept.where(F.col(TS) < time_literal(windows.holdout_end))
    return kept


def unique_posts(posts: DataFrame) -> DataFrame:
    """One row per post address: the earliest, ties by author and text."""
    return one_per_key(posts.select(*META), [POST], [TS, USER, "record_text"])


def eligible_hours(posts: DataFrame, hours: int = ELIGIBLE_HOURS) -> DataFrame:
    """One row per post and hour, from the hour it was made, for ``hours`` hours."""
    first = hour_bucket(TS)
    last = first + F.make_dt_interval(hours=F.lit(hours - 1))
    return posts.withColumn(NEG_HOUR, F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))))


def inside_bounds(expanded: DataFrame, windows: Windows, posts_end: str | None = None) -> DataFrame:
    """Hours from the start of training up to the earlier of ``posts_end`` and the end of the holdout."""
    kept = expanded.where(F.col(NEG_HOUR) >= time_literal(windows.train_start))
    for bound in (posts_end, windows.holdout_end):
        if bound is not None:
            kept = kept.where(F.col(NEG_HOUR) < time_literal(bound))
    return kept


def hourly_scores(expanded: DataFrame, alpha: float = NEGATIVE_ALPHA, seed: int = SEED) -> DataFrame:
    """Sampling score of every (post, hour); the smallest win."""
    drawn = uniform(seeded_hash(seed, "negative", POST, F.date_format(NEG_HOUR, HOUR_TEXT)))
    return expanded.withColumn("sample_score", sample_score(drawn, "global_like_count", alpha))


def choose_hourly(
    posts: DataFrame,
    counts: DataFrame,
    windows: Windows,
    per_hour: int = NEGATIVES_PER_HOUR,
    alpha: float = NEGATIVE_ALPHA,
    seed: int = SEED,
    posts_end: str | None = None,
    share: float | None = None,
) -> DataFrame:
    """``(at_uri, negative_hour_bucket)`` of the sampled posts of each hour.

    Works on address and first time only; copies of a post go in the map tasks.
    There are few hours and each takes a large part of the table, so ranks are
    salted.  The upper bounds drop whole hours and are applied before the ranking.
    ``share`` is the one that ``counts`` was sampled with: other posts drop out in
    the scan, by the same hash, before they are grouped.
    """
    if share is not None:
        posts = posts.where(candidate_sample(POST, share, seed))
    created = posts.groupBy(POST).agg(F.min(TS).alias(TS))
    weighted = created.join(counts.withColumnRenamed(ITEM, POST), POST)
    expanded = inside_bounds(eligible_hours(weighted), windows, posts_end)
    scored = hourly_scores(expanded, alpha, seed).select(POST, NEG_HOUR, "sample_score")
    best = top_n_per_group(scored, [NEG_HOUR], ["sample_score", POST], per_hour, salt_of(POST))
    return best.select(POST, NEG_HOUR)


def metadata_of(posts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Metadata of the wanted posts, one row each; the text of other posts never moves."""
    return unique_posts(semi_join_spread(posts.select(*META), wanted, POST))


def describe_negatives(chosen: DataFrame, metadata: DataFrame, liked: DataFrame) -> DataFrame:
    """Sampled posts with their metadata and the liked flag."""
    marker = liked.select(F.col(ITEM).alias(POST)).distinct().withColumn("is_liked", F.lit(True))
    return (
        chosen.join(metadata, POST)
        .join(marker, POST, "left")
        .select(
            *META,
            F.coalesce("is_liked", F.lit(False)).alias("is_liked"),
            F.lit(True).alias("in_random_sample"),
            NEG_HOUR,
        )
    )


def hourly_negatives(
    posts: DataFrame,
    counts: DataFrame,
    liked: DataFrame,
    windows: Windows,
    per_hour: int = NEGATIVES_PER_HOUR,
    alpha: float = NEGATIVE_ALPHA,
    seed: int = SEED,
    posts_end: str | None = None,
    share: float | None = None,
) -> DataFrame:
    """Popularity-weighted sample of posts for each hour of their first day."""
    chosen = cut(choose_hourly(posts, counts, windows, per_hour, alpha, seed, posts_end, share))
    return describe_negatives(chosen, metadata_of(posts, chosen), liked)


def liked_only_posts(posts: DataFrame, liked: DataFrame, negatives: DataFrame) -> DataFrame:
    """Liked posts that were not sampled, without an hour."""
    return (
        posts.select(*META)
        .join(liked.select(F.col(ITEM).alias(POST)).distinct(), POST, "left_semi")
        .join(negatives.select(POST).distinct(), POST, "left_anti")
        .select(
            *META,
            F.lit(True).alias("is_liked"),
            F.lit(False).alias("in_random_sample"),
            F.lit(None).cast("timestamp").alias(NEG_HOUR),
        )
    )


def combine_posts(negatives: DataFrame, liked_only: DataFrame) -> DataFrame:
    """Both parts, one row per post, metadata and hour."""
    both = negatives.unionByName(liked_only)
    # Preferring sampled and liked rows makes the choice among copies total.
    return one_per_key(both, [*META, NEG_HOUR], [F.col("in_random_sample").desc(), F.col("is_liked").desc()])


def posts_core(
    posts: DataFrame,
    counts: DataFrame,
    likes: DataFrame,
    windows: Windows,
    per_hour: int = NEGATIVES_PER_HOUR,
    alpha: float = NEGATIVE_ALPHA,
    seed: int = SEED,
    posts_end: str | None = None,
    share: float | None = None,
) -> DataFrame:
    """Sampled negatives and liked posts with the window each belongs to.

    Two passes over the posts: a narrow one that draws the sample and one that
    fetches the metadata of sampled and liked posts only.
    """
    inside = post_window(posts, windows)
    liked = likes.select(ITEM).distinct()
    chosen = cut(choose_hourly(inside, counts, windows, per_hour, alpha, seed, posts_end, share))
    wanted = chosen.select(POST).unionByName(liked.select(F.col(ITEM).alias(POST)))
    metadata = cut(metadata_of(inside, wanted))
    negatives = describe_negatives(chosen, metadata, liked)
    combined = combine_posts(negatives, liked_only_posts(metadata, liked, chosen))
    return combined.withColumn(
        "split_window", post_split_window(F.col("in_random_sample"), F.col(NEG_HOUR), F.col(TS), windows)
    )


def posts_stats(core: DataFrame, liked: DataFrame) -> DataFrame:
    """Sizes of the parts of a posts core table and the share of liked posts found.

    One row per post is built first, so the distinct counts become plain counts.
    """
    sampled = F.col("in_random_sample")
    per_post = core.groupBy(POST).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(sampled).alias("sampled_rows"),
        F.bool_or("is_liked").alias("liked"),
        F.bool_or(F.col("is_liked") & ~sampled).alias("liked_only"),
        F.bool_or(F.col("is_liked") & sampled).alias("liked_sampled"),
    )
    hours = core.where(sampled).select(NEG_HOUR).distinct().agg(F.count(NEG_HOUR).alias("n"))
    n_liked = liked.select(ITEM).distinct().agg(F.count(F.lit(1)).alias("n"))
    return per_post.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_posts_core"),
        F.count(F.lit(1)).alias("n_posts_core_unique"),
        F.count_if("liked").alias("n_liked_posts"),
        F.count_if("liked_only").alias("n_liked_only"),
        F.count_if("liked_sampled").alias("n_liked_in_random_sample"),
        F.coalesce(F.sum("sampled_rows"), F.lit(0)).alias("n_random_sample"),
        F.count_if(F.col("sampled_rows") > 0).alias("n_random_sample_unique_posts"),
    ).select(
        "*",
        hours.scalar().alias("n_random_sample_buckets"),
        F.coalesce(
            F.lit(100.0) * F.col("n_liked_posts") / F.nullif(n_liked.scalar(), F.lit(0)), F.lit(0.0)
        ).alias("liked_post_match_rate"),
    )
