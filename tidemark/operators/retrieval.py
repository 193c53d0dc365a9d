"""Top-k retrieval for a user and author concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hashing import seeded_hash
from tidemark.functions.vectors import dot_score, l2_normalised, summary_vector
from tidemark.names import AUTHOR, EMA_ALPHA, EMB, HOUR, ITEM, POST, SEED, TS, USER
from tidemark.operators.history import prior_items
from tidemark.plans.durable import cut
from tidemark.plans.ordered import first_by_hash, with_position
from tidemark.plans.scalars import row_of
from tidemark.plans.sizes import broadcast_if_bounded
from tidemark.plans.topn import one_per_key, salt_of, top_n_per_group

TARGET_ROW_BYTES = 100


def check_top_k(k: int, min_likes: int | None = None) -> None:
    if k <= 0:
        raise ValueError("top_k must be positive")
    if min_likes is not None and min_likes < 0:
        raise ValueError("min_likes must not be negative")


def recent_likes(likes: DataFrame, user: str | Column, n: int) -> DataFrame:
    """The last ``n`` likes of one user, newest first, with their rank."""
    latest = likes.where(F.col(USER) == user).orderBy(F.col(TS).desc(), ITEM).limit(n)
    newest_first = Window.orderBy(F.col(TS).desc(), ITEM)  # n rows
    return latest.withColumn("rank", F.row_number().over(newest_first))


def history_posts(recent: DataFrame, posts: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """History entries with author and vector; a vector of another length counts as none.

    ``recent`` has a bounded number of rows: posts and vectors are first reduced to
    them where they lie.
    """
    vector = F.when(F.size("embedding") == dim, F.col("embedding"))
    entries = recent.select("rank", F.col(ITEM).alias(POST))
    wanted = F.broadcast(entries.select(POST).distinct())
    return (
        entries.join(posts.select(POST, F.col(USER).alias(AUTHOR)).join(wanted, POST, "left_semi"), POST, "left")
        .join(embeddings.select(POST, vector.alias("embedding")).join(wanted, POST, "left_semi"), POST, "left")
        .withColumn("embedding_present", F.col("embedding").isNotNull())
    )


def user_vector(
    history: DataFrame, dim: int, kind: str = "mean", ema_alpha: float = EMA_ALPHA, normalise: bool = False
) -> DataFrame:
    """One row: the summary of a user's history vectors, newest first."""
    entries = history.where("embedding_present").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "embedding"))), lambda e: e["embedding"]).alias("v")
    )
    # A summary is made on Arrow batches, which no lambda may hold: it is a column before it is normalised.
    summary = entries.select(summary_vector("v", dim, kind, ema_alpha).alias("summary"))
    return summary.select(l2_normalised("summary", normalise).alias("user_vector"))


def unique_candidates(posts: DataFrame) -> DataFrame:
    """One row per post with a vector; the earliest wins, ties by author."""
    return one_per_key(posts.where(F.col("embedding").isNotNull()), [POST], [TS, AUTHOR])


def unique_scored(scored: DataFrame) -> DataFrame:
    """The same choice after scoring: rows are narrow then, the vectors never move."""
    return one_per_key(scored, ["model_run_id", POST], [TS, AUTHOR, F.col("score").desc()])


def score_posts(
    posts: DataFrame, user_vectors: dict[str, DataFrame], dim: int, temperature: float = 1.0
) -> DataFrame:
    """Score every post for each model.

    A model's user vector is one row; it enters the scan as a scalar subquery, so
    the posts stay where they are and are read once for all models.
    """
    usable = posts.where(F.size("embedding") == dim)
    usable = usable.withColumns({f"_user_{i}": v.scalar() for i, v in enumerate(user_vectors.values())})
    entries = [
        F.struct(
            F.lit(model).alias("model_run_id"), dot_score(f"_user_{i}", "embedding", temperature).alias("score")
        )
        for i, model in enumerate(user_vectors)
    ]
    return usable.select(POST, AUTHOR, TS, F.explode(F.array(*entries)).alias("_m")).select(
        POST, AUTHOR, TS, "_m.model_run_id", "_m.score"
    )


def top_k(scored: DataFrame, k: int, keys: Sequence[str] = ("model_run_id",)) -> DataFrame:
    """The ``k`` best posts per model with ranks.

    There are few models and each takes the whole table, so ranks are salted.
    """
    return top_n_per_group(scored, list(keys), [F.col("score").desc(), POST], k, salt_of(POST), rank_name="rank")


def global_top_k(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best posts of the whole table."""
    return scored.orderBy(F.col("score").desc(), POST).limit(k)


def top_k_with_floor(
    scored: DataFrame, like_counts: DataFrame, k: int, min_likes: int | None, keys: Sequence[str] = ("model_run_id",)
) -> DataFrame:
    """The ``k`` best posts with at least ``min_likes`` likes, and their counts.

    The floor goes first, so ``k`` posts come back whenever ``k`` reach it.  Without
    a floor counts are only fetched for the posts in the list.
    """
    check_top_k(k, min_likes)
    if min_likes is None:
        return top_k(scored, k, keys).join(like_counts, POST, "left")
    return top_k(scored.join(like_counts.where(F.col("like_count") >= min_likes), POST), k, keys)


def author_concentration(top: DataFrame, keys: Sequence[str] = ("model_run_id",)) -> DataFrame:
    """Posts and best rank of each author in a top list."""
    return top.groupBy(*keys, AUTHOR).agg(F.count(F.lit(1)).alias("count"), F.min("rank").alias("best_rank"))


def sorted_authors(counts: DataFrame, keys: Sequence[str] = ("model_run_id",)) -> DataFrame:
    return counts.orderBy(*keys, F.col("count").desc(), "best_rank", AUTHOR)


def retrieval_summary(top: DataFrame, candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Returned posts and score range per model, with the scanned and history counts."""
    with_vector = candidates.where(F.col("embedding").isNotNull()).select(POST).distinct()
    scanned = with_vector.agg(F.count(F.lit(1)).alias("n"))
    likes = history.agg(F.count(F.lit(1)).alias("n"), F.count_if("embedding_present").alias("e"))
    return (
        top.groupBy("model_run_id")
        .agg(
            F.count(F.lit(1)).alias("top_k_returned"),
            F.min("score").alias("score_min"),
            F.max("score").alias("score_max"),
        )
        .withColumns({"n_candidate_posts_scanned": scanned.scalar(), "_likes": row_of(likes)})
        .withColumns({"n_history_likes": F.col("_likes.n"), "n_embeddable_history_posts": F.col("_likes.e")})
        .drop("_likes")
    )


def sampled_prior_likes(likes: DataFrame, n_targets: int, max_prior: int, seed: int = SEED) -> DataFrame:
    """A hash sample of likes with an earlier like, each with its latest earlier posts.

    Likes of earlier hours come from the history pieces, those of the same hour from
    the sampled targets' own hour, so that no target meets all likes of its user.
    """
    targets = cut(
        first_by_hash(
            with_position(likes.select(USER, HOUR, TS, ITEM, EMB), [USER], [TS, EMB, ITEM], "_order")
            .where(F.col("_order") > 0)
            .withColumn("_hash", seeded_hash(seed, "target", USER, ITEM, F.unix_micros(TS))),
            n_targets,
            "_hash",
            [USER, ITEM, TS],
        )
        .drop("_hash", "_order")
        .withColumnsRenamed({TS: "target_ts", EMB: "target_emb_idx", ITEM: "target_uri"})
    )
    users, _ = broadcast_if_bounded(targets.select(USER).distinct(), n_targets, TARGET_ROW_BYTES)
    theirs = likes.join(users, USER, "left_semi")
    before_hour = prior_items(theirs, max_prior).select(USER, HOUR, "prior")
    entry = F.struct(F.col(TS).alias("ts"), F.col(EMB).alias("emb"))
    same_hour = top_n_per_group(
        targets.join(theirs.select(USER, HOUR, TS, EMB), [USER, HOUR]).where(F.col(TS) < F.col("target_ts")),
        [USER, "target_uri", "target_ts"],
        [F.col(TS).desc(), F.col(EMB).desc()],
        max_prior,
    )
    recent = same_hour.groupBy(USER, "target_uri", "target_ts").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("_recent")
    )
    older = F.transform("prior", lambda e: e["emb_idx"])
    newer = F.coalesce(F.transform("_recent", lambda e: e["emb"]), F.array().cast("array<long>"))
    return cut(
        targets.join(recent, [USER, "target_uri", "target_ts"], "left")
        .join(before_hour, [USER, HOUR])
        .select(
            USER,
            "target_uri",
            "target_ts",
            "target_emb_idx",
            F.slice(F.concat(newer, older), 1, max_prior).alias("prior_emb_indices"),
        )
    )


def mean_prior_vectors(targets: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """Mean vector of each target's earlier posts, the zero vector without any."""
    keys = [USER, "target_uri", "target_ts"]
    entries = targets.select(*keys, F.posexplode_outer("prior_emb_indices").alias("pos", EMB))
    joined = entries.join(embeddings.select(EMB, "embedding"), EMB, "left")
    lists = joined.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("embedding").isNotNull(), F.struct("pos", "embedding")))).alias("l")
    )
    vectors = F.transform("l", lambda e: e["embedding"])
    return lists.select(*keys, F.size("l").alias("n_prior"), summary_vector(vectors, dim).alias("mean_vector"))
