"""The whole flow: core tables, then history, as durable tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions.splits import Windows
from tidemark.operators import authors, history, likes as likes_ops, popularity, posts as posts_ops
from tidemark.operators.cohorts import cohort_size_bound, sample_cohorts
from tidemark.plans.durable import cut
from tidemark.plans.spread import spread_join
from tidemark.plans.topn import one_per_key
from tidemark.sources import embeddings as emb
from tidemark.sources.tables import scan, write_table


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; the defaults are the library's."""

    windows: Windows
    min_likes: int = N.MIN_LIKES_PER_USER
    max_likes: int = N.MAX_LIKES_PER_USER
    max_trainval: int | None = None
    max_unseen: int | None = None
    negative_share: float = N.NEGATIVE_SAMPLE_PCT
    min_negative_likes: int = N.MIN_LIKES_PER_NEGATIVE
    negatives_per_hour: int = N.NEGATIVES_PER_HOUR
    negative_alpha: float = N.NEGATIVE_ALPHA
    min_author_support: int = N.MIN_AUTHOR_SUPPORT
    max_prior: int | None = None
    seed: int = N.SEED
    posts_end: str | None = None


@dataclass(frozen=True)
class CoreTables:
    cohorts: DataFrame
    sampled_likes: DataFrame
    sampled_posts: DataFrame
    likes: DataFrame
    posts: DataFrame
    embeddings: DataFrame | None
    authors: DataFrame
    curve: DataFrame


def with_post_ids(likes: DataFrame, posts: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Add the embedding id and the author of the liked post; one row per (user, post).

    Hot posts are parted; ``measured`` may be a written table with the same posts.
    """
    ids = posts.select(F.col(N.POST).alias(N.ITEM), N.EMB, F.col(N.USER).alias(N.AUTHOR))
    # A post has one row per sampled hour; its id and author are the same in all.
    unique = one_per_key(ids, [N.ITEM], [N.EMB, N.AUTHOR])
    first_like = one_per_key(likes, [N.USER, N.ITEM], [N.TS])
    return spread_join(first_like, unique, N.ITEM, measured=measured)


def core_tables(
    raw_likes: DataFrame,
    raw_posts: DataFrame,
    settings: Settings,
    vector: Column | None = None,
    dim: int | None = None,
    folder: str | None = None,
) -> CoreTables:
    """Likes, posts, embeddings, authors and popularity curve from the raw tables.

    ``vector`` is the expression that yields a post's vector; without it every post
    gets an id and no embeddings are made.  The raw likes are read three times: to
    count users, to count hours, and to pick the sampled likes.  Tables with
    several readers are written, so nothing is computed twice and a lost executor
    costs a read, not a rerun.  The final tables go to ``folder`` when it is given.
    """
    s = settings

    def keep(df: DataFrame, name: str) -> DataFrame:
        return cut(df) if folder is None else write_and_read(df, f"{folder}/{name}")

    cohorts = cut(sample_cohorts(raw_likes, s.min_likes, s.max_trainval, s.max_unseen, s.seed))
    bound = cohort_size_bound(s.max_trainval, s.max_unseen)
    sampled_likes = cut(likes_ops.likes_core(raw_likes, cohorts, s.windows, s.max_likes, s.seed, bound))

    hourly = cut(popularity.hourly_likes(raw_likes))
    counts = popularity.candidate_counts(hourly, s.negative_share, s.min_negative_likes, s.seed)
    sampled_posts = cut(
        posts_ops.posts_core(
            raw_posts, counts, sampled_likes, s.windows, s.negatives_per_hour, s.negative_alpha, s.seed, s.posts_end,
            s.negative_share,
        )
    )

    prior = cut(popularity.prior_popularity(hourly, popularity.needed_post_hours(sampled_likes, sampled_posts)))
    likes = popularity.with_prior_on_likes(sampled_likes, prior)
    posts = popularity.with_prior_on_posts(sampled_posts, prior)

    if vector is None:
        embeddings = None
        ids = cut(emb.dense_ids(sampled_posts, N.POST, N.EMB))
    else:
        if dim is None:
            raise ValueError("dim is needed to check the vectors")
        vectors = emb.candidate_vectors(raw_posts, sampled_posts, vector)
        numbered = emb.numbered(cut(emb.first_valid(vectors, dim)))
        embeddings = emb.require_embeddings(keep(numbered, "embeddings"))
        ids = embeddings.select(N.POST, N.EMB)
    posts = cut(posts.join(ids, N.POST))

    likes = cut(with_post_ids(likes_ops.reverify(likes, posts, s.min_likes, sampled_likes), posts, sampled_likes))
    index = keep(authors.author_index(posts, likes, s.min_author_support), "author_idx")
    curve = popularity.popularity_curve(hourly, likes.select(N.ITEM, N.EMB).distinct())
    return CoreTables(
        cohorts,
        sampled_likes,
        sampled_posts,
        keep(authors.with_author_idx(likes, index, N.AUTHOR), "likes_core"),
        keep(authors.with_author_idx(posts, index, N.USER), "posts_core"),
        embeddings,
        index,
        keep(curve, "liked_post_hour_cumulative_likes"),
    )


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Write a table as zstd parquet and go on from the written copy."""
    write_table(df, path)
    return scan(df.sparkSession, path)


def history_table(tables: CoreTables, settings: Settings) -> DataFrame:
    """User history of the core tables."""
    return cut(history.user_history(tables.likes, tables.curve, settings.max_prior))
