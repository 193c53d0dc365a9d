"""Filters, joins, windows, sorts and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions.splits import like_split
from tidemark.functions.vectors import dot
from tidemark.operators import cohorts, history as history_ops, likes as likes_ops, popularity, posts as posts_ops
from tidemark.operators import ranking, retrieval
from tidemark.plans.asof import asof_backward
from tidemark.plans.ordered import with_position
from tidemark.plans.topn import one_per_key, salt_of, top_n_per_group
from tidemark.queries import scored as sc
from tidemark.queries import tables as t
from tidemark.queries.oracle import END, TRAIN, hour, listed, micro, rnd, with_
from tidemark.queries.registry import query
from tidemark.queries.scalars import labelled
from tidemark.sources.embeddings import dense_ids

# -- filters ---------------------------------------------------------------


@query("c1_min_likes", with_("SELECT did, like_count FROM eligible"))
def c1(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.eligible_users(t.raw_likes(spark, sf), t.MIN_LIKES)


@query(
    "c1_min_likes_orders",
    """SELECT CAST(o_custkey AS VARCHAR) AS did, count(*) AS like_count
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) >= 20""",
)
def c1_orders(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.eligible_users(t.orders_likes(spark, sf), 20)


@query(
    "c2_cohort_window",
    with_(f"SELECT did, subject_uri, {micro('record_created_at')} AS record_created_at, like_count FROM labelled"),
)
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select(N.USER, N.ITEM, t.micro_text(N.TS).alias(N.TS), "like_count")


@query("c3_null_split_guard", with_("SELECT split, count(*) AS n_likes FROM labelled GROUP BY split"))
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return likes_ops.split_or_error(labelled(spark, sf)).groupBy("split").agg(F.count(F.lit(1)).alias("n_likes"))


@query("c4_post_window", with_(f"SELECT at_uri, {micro('record_created_at')} AS record_created_at FROM window_posts"))
def c4(spark: SparkSession, sf: str) -> DataFrame:
    kept = posts_ops.post_window(t.raw_posts(spark, sf), t.WINDOWS)
    return kept.select(N.POST, t.micro_text(N.TS).alias(N.TS))


@query(
    "c5_bucket_bounds",
    with_(f"""SELECT {hour('negative_hour_bucket')} AS negative_hour_bucket, count(*) AS n_posts FROM expanded
              WHERE negative_hour_bucket >= {TRAIN} AND negative_hour_bucket < {END} GROUP BY ALL"""),
)
def c5(spark: SparkSession, sf: str) -> DataFrame:
    return _posts_per_hour(posts_ops.inside_bounds(_expanded(spark, sf), t.WINDOWS))


def _posts_per_hour(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy(t.time_text(N.NEG_HOUR).alias(N.NEG_HOUR)).agg(F.count(F.lit(1)).alias("n_posts"))


POSTS_END = "2024-01-28 07:00:00"


@query(
    "c5_posts_end",
    with_(
        f"""SELECT {hour('negative_hour_bucket')} AS negative_hour_bucket, at_uri FROM early""",
        early=f"""SELECT at_uri, negative_hour_bucket FROM (
                    SELECT *, row_number() OVER (PARTITION BY negative_hour_bucket ORDER BY sample_score, at_uri) AS rn
                    FROM scored WHERE negative_hour_bucket < TIMESTAMP '{POSTS_END}')
                  WHERE rn <= {t.NEGATIVES_PER_HOUR}""",
    ),
)
def c5_posts_end(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly draw where the posts end before the holdout does."""
    window = posts_ops.post_window(t.raw_posts(spark, sf), t.WINDOWS)
    chosen = posts_ops.choose_hourly(
        window, _counts(spark, sf), t.WINDOWS, t.NEGATIVES_PER_HOUR, posts_end=POSTS_END, share=t.NEGATIVE_SHARE
    )
    return chosen.select(t.time_text(N.NEG_HOUR).alias(N.NEG_HOUR), N.POST)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return popularity.candidate_counts(t.raw_likes(spark, sf), t.NEGATIVE_SHARE, t.MIN_NEGATIVE_LIKES)


def _expanded(spark: SparkSession, sf: str) -> DataFrame:
    window = posts_ops.post_window(t.raw_posts(spark, sf), t.WINDOWS)
    counts = _counts(spark, sf).withColumnRenamed(N.ITEM, N.POST)
    return posts_ops.eligible_hours(window.select(N.POST, N.TS).join(counts, N.POST))


@query("c6_min_global_likes", with_("SELECT subject_uri, global_like_count FROM candidate_counts"))
def c6(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query(
    "c7_membership",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
       WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
         AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def c7(spark: SparkSession, sf: str) -> DataFrame:
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rich = t.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    done = t.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return cohorts.keep_members(cohorts.keep_members(lines, rich, "l_suppkey"), done, "l_orderkey")


# -- joins -----------------------------------------------------------------


@query(
    "d1_inner_join",
    with_("SELECT did, user_cohort, count(*) AS n_likes, count(DISTINCT subject_uri) AS n_posts"
          " FROM raw_likes JOIN cohorts USING (did) GROUP BY ALL"),
)
def d1(spark: SparkSession, sf: str) -> DataFrame:
    run, likes = t.settings(spark, sf), t.raw_likes(spark, sf)
    sampled = cohorts.sample_cohorts(likes, run.min_likes, run.max_trainval, run.max_unseen, run.seed)
    bound = cohorts.cohort_size_bound(run.max_trainval, run.max_unseen)
    joined = likes_ops.likes_of_cohorts(likes, sampled, bound)
    per_post = joined.groupBy(N.USER, "_user_cohort", N.ITEM).agg(F.count(F.lit(1)).alias("n"))
    return per_post.groupBy(N.USER, F.col("_user_cohort").alias("user_cohort")).agg(
        F.sum("n").alias("n_likes"), F.count(F.lit(1)).alias("n_posts")
    )


@query(
    "d2_left_join_fill",
    with_(f"""SELECT l.did, l.subject_uri, {micro('l.record_created_at')} AS record_created_at,
                     coalesce(p.prior_cumulative_likes, 0) AS prior_cumulative_likes
              FROM sampled_likes l LEFT JOIN prior p
                ON p.subject_uri = l.subject_uri AND p.target_hour = l.like_hour_bucket"""),
)
def d2(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    needed = popularity.needed_post_hours(core.sampled_likes, core.sampled_posts)
    prior = popularity.prior_popularity(popularity.hourly_likes(t.raw_likes(spark, sf)), needed)
    filled = popularity.with_prior_on_likes(core.sampled_likes, prior)
    return filled.select(N.USER, N.ITEM, t.micro_text(N.TS).alias(N.TS), N.PRIOR)


@query(
    "d3_left_semi",
    with_("SELECT subject_uri, count(*) AS n_likes FROM raw_likes"
          " WHERE subject_uri IN (SELECT subject_uri FROM needed) GROUP BY subject_uri"),
)
def d3(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    needed = popularity.needed_post_hours(core.sampled_likes, core.sampled_posts)
    counts = t.raw_likes(spark, sf).groupBy(N.ITEM).agg(F.count(F.lit(1)).alias("n_likes"))
    return cohorts.keep_members(counts, needed, N.ITEM)


@query(
    "d4_left_anti",
    with_("SELECT did, like_count FROM eligible WHERE did NOT IN (SELECT did FROM trainval)"),
)
def d4(spark: SparkSession, sf: str) -> DataFrame:
    run, likes = t.settings(spark, sf), t.raw_likes(spark, sf)
    eligible = cohorts.eligible_users(likes, run.min_likes)
    trainval = cohorts.capped_users(eligible, run.max_trainval, "trainval", run.seed)
    return cohorts.drop_members(eligible, trainval, N.USER)


ASOF_SQL = f"""
    SELECT t.part, {hour('t.at')} AS at, coalesce(c.price, 0) AS price
    FROM (SELECT DISTINCT l_partkey AS part, o_orderdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t
    ASOF LEFT JOIN (SELECT l_partkey AS part, l_shipdate AS shipped, max(l_extendedprice) AS price
                    FROM lineitem GROUP BY ALL) c
      ON c.part = t.part AND c.shipped <= t.at"""


def _asof(spark: SparkSession, sf: str, segment: str | None) -> DataFrame:
    """Last shipped price of a part at the date of each order for it."""
    lines = t.table(spark, sf, "lineitem")
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    targets = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("part"), F.col("o_orderdate").cast("timestamp").alias("at")
    )
    curve = lines.groupBy(F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("timestamp").alias("shipped")).agg(
        F.max("l_extendedprice").alias("price")
    )
    found = asof_backward(targets, curve, "part", "at", "shipped", "price", default=0, segment=segment)
    return found.select("part", t.time_text("at").alias("at"), "price")


@query("d5_asof_backward", ASOF_SQL)
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return _asof(spark, sf, None)


@query("d5_asof_segmented", ASOF_SQL)
def d5_segmented(spark: SparkSession, sf: str) -> DataFrame:
    return _asof(spark, sf, "quarter")


PRIOR_SQL = with_(
    f"""SELECT u.did, {hour('u.like_hour_bucket')} AS like_hour_bucket, coalesce(max(p.raw_prior_count), 0) AS raw_prior_count,
               coalesce({listed('list(p.emb_idx ORDER BY p.pos) FILTER (p.pos IS NOT NULL)')}, '') AS prior
        FROM (SELECT DISTINCT did, like_hour_bucket FROM likes_core) u
        LEFT JOIN (SELECT * FROM prior_pairs WHERE pos <= {t.MAX_PRIOR}) p USING (did, like_hour_bucket)
        GROUP BY u.did, u.like_hour_bucket"""
)


@query("d6_range_self_join", PRIOR_SQL)
def d6(spark: SparkSession, sf: str) -> DataFrame:
    prior = history_ops.prior_items(t.core(spark, sf).likes, t.MAX_PRIOR)
    return prior.select(
        N.USER,
        t.time_text(N.HOUR).alias(N.HOUR),
        "raw_prior_count",
        t.list_text(F.transform("prior", lambda e: e[N.EMB])).alias("prior"),
    )


@query(
    "d7_candidates_by_hour",
    with_(f"""SELECT split, {hour('like_hour_bucket')} AS like_hour_bucket, batch_id, did, count(*) AS n_candidates,
                     CAST(sum(label) AS BIGINT) AS n_positive, CAST(sum(prior_cumulative_likes) AS BIGINT) AS prior_total
              FROM pairs GROUP BY ALL"""),
)
def d7(spark: SparkSession, sf: str) -> DataFrame:
    pairs = sc.pairs(spark, sf)
    return pairs.groupBy(*sc.KEYS).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum("label").alias("n_positive"),
        F.sum(N.PRIOR).cast("long").alias("prior_total"),
    ).withColumn(N.HOUR, t.time_text(N.HOUR))


# -- windows ---------------------------------------------------------------


CAP_SQL = """
    SELECT did, subject_uri, {ts} AS record_created_at FROM (
      SELECT *, row_number() OVER (PARTITION BY did ORDER BY {order}) AS rn FROM raw_likes) WHERE rn <= 40"""


@query(
    "f1_random_cap",
    with_(CAP_SQL.format(
        ts=micro("record_created_at"),
        order="md5('42:cap:' || did || ':' || subject_uri), subject_uri, record_created_at")),
)
def f1(spark: SparkSession, sf: str) -> DataFrame:
    capped = likes_ops.random_cap(t.raw_likes(spark, sf), t.MAX_LIKES)
    return capped.select(N.USER, N.ITEM, t.micro_text(N.TS).alias(N.TS))


@query(
    "f1_random_cap_orders",
    f"""SELECT did, subject_uri, {hour('record_created_at')} AS record_created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY did ORDER BY md5('42:cap:' || did || ':' || subject_uri),
                                       subject_uri, record_created_at) AS rn
          FROM (SELECT CAST(o_custkey AS VARCHAR) AS did, CAST(l_partkey AS VARCHAR) AS subject_uri,
                       o_orderdate AS record_created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
        WHERE rn <= 25""",
)
def f1_orders(spark: SparkSession, sf: str) -> DataFrame:
    capped = likes_ops.random_cap(t.orders_likes(spark, sf), 25)
    return capped.select(N.USER, N.ITEM, t.time_text(N.TS).alias(N.TS))


@query(
    "f2_recency_cap",
    with_(CAP_SQL.format(ts=micro("record_created_at"), order="record_created_at DESC, subject_uri")),
)
def f2(spark: SparkSession, sf: str) -> DataFrame:
    capped = likes_ops.recency_cap(t.raw_likes(spark, sf), t.MAX_LIKES)
    return capped.select(N.USER, N.ITEM, t.micro_text(N.TS).alias(N.TS))


@query(
    "f3_hourly_top_n",
    with_(f"SELECT at_uri, {hour('negative_hour_bucket')} AS negative_hour_bucket FROM chosen"),
)
def f3(spark: SparkSession, sf: str) -> DataFrame:
    inside = _expanded(spark, sf).where(
        (F.col(N.NEG_HOUR) >= F.lit(t.WINDOWS.train_start).cast("timestamp"))
        & (F.col(N.NEG_HOUR) < F.lit(t.WINDOWS.holdout_end).cast("timestamp"))
    )
    scores = posts_ops.hourly_scores(inside)
    best = top_n_per_group(scores, [N.NEG_HOUR], ["sample_score", N.POST], t.NEGATIVES_PER_HOUR, salt_of(N.POST))
    return best.select(N.POST, t.time_text(N.NEG_HOUR).alias(N.NEG_HOUR))


@query(
    "f4_running_total",
    with_(f"""SELECT subject_uri, {hour("like_hour + INTERVAL 1 HOUR")} AS popularity_hour_bucket,
                     CAST(sum(likes_this_hour) OVER (PARTITION BY subject_uri ORDER BY like_hour) AS BIGINT)
                     AS prior_cumulative_likes FROM hourly"""),
)
def f4(spark: SparkSession, sf: str) -> DataFrame:
    curve = popularity.cumulative_curve(popularity.hourly_likes(t.raw_likes(spark, sf)))
    return curve.withColumn(popularity.CURVE_HOUR, t.time_text(popularity.CURVE_HOUR))


@query(
    "f4_running_total_orders",
    """SELECT l_partkey AS part, strftime(o_orderdate, '%Y-%m-%d') AS day,
              CAST(sum(count(*)) OVER (PARTITION BY l_partkey ORDER BY o_orderdate) AS BIGINT) AS so_far
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, o_orderdate""",
)
def f4_orders(spark: SparkSession, sf: str) -> DataFrame:
    curve = popularity.cumulative_curve(popularity.hourly_likes(t.orders_likes(spark, sf)))
    return curve.select(
        F.col(N.ITEM).cast("long").alias("part"),
        F.date_format(popularity.CURVE_HOUR, "yyyy-MM-dd").alias("day"),
        F.col(N.PRIOR).alias("so_far"),
    )


@query(
    "f5_partition_count",
    with_(f"""SELECT did, {hour('like_hour_bucket')} AS like_hour_bucket,
                     CAST(coalesce(sum(n) OVER (PARTITION BY did ORDER BY like_hour_bucket
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS raw_prior_count
              FROM (SELECT did, date_trunc('hour', record_created_at) AS like_hour_bucket, count(*) AS n
                    FROM raw_likes GROUP BY ALL)"""),
)
def f5(spark: SparkSession, sf: str) -> DataFrame:
    """Likes of the user before each of their hours, over all likes."""
    likes = t.raw_likes(spark, sf).withColumn(N.HOUR, F.date_trunc("hour", N.TS)).withColumn(N.EMB, F.lit(0))
    prior = history_ops.prior_items(likes, 1)
    return prior.select(N.USER, t.time_text(N.HOUR).alias(N.HOUR), "raw_prior_count")


@query(
    "f6_recency_rank",
    with_(f"""SELECT did, {hour('like_hour_bucket')} AS like_hour_bucket, emb_idx, pos
              FROM prior_pairs WHERE pos <= {t.MAX_PRIOR}"""),
)
def f6(spark: SparkSession, sf: str) -> DataFrame:
    prior = history_ops.prior_items(t.core(spark, sf).likes, t.MAX_PRIOR)
    entries = prior.select(N.USER, N.HOUR, F.posexplode("prior").alias("pos", "e"))
    return entries.select(
        N.USER,
        t.time_text(N.HOUR).alias(N.HOUR),
        F.col(f"e.{N.EMB}").cast("long").alias(N.EMB),
        (F.col("pos") + 1).cast("long").alias("pos"),
    )


@query(
    "f7_like_position",
    with_(f"""SELECT did, subject_uri, {micro('record_created_at')} AS record_created_at, like_order FROM (
                SELECT *, row_number() OVER (PARTITION BY did ORDER BY record_created_at, subject_uri) AS like_order
                FROM raw_likes) WHERE like_order > 1"""),
)
def f7(spark: SparkSession, sf: str) -> DataFrame:
    placed = likes_ops.like_positions(t.raw_likes(spark, sf)).where("like_order > 1")
    return placed.select(N.USER, N.ITEM, t.micro_text(N.TS).alias(N.TS), "like_order")


@query(
    "f8_cumulative_relevance",
    with_(f"""SELECT split, {hour('like_hour_bucket')} AS like_hour_bucket, did, post_id, rank,
                     CAST(hits AS BIGINT) AS hits, {rnd('hits / rank')} AS precision_at_rank,
                     {rnd('1 / log2(rank + 1)')} AS discount FROM ranked"""),
)
def f8(spark: SparkSession, sf: str) -> DataFrame:
    ranked = ranking.ranked(sc.scored(spark, sf), sc.KEYS)
    rank = F.col("rank").cast("double")
    return ranked.select(
        "split",
        t.time_text(N.HOUR).alias(N.HOUR),
        N.USER,
        "post_id",
        F.col("rank").cast("long").alias("rank"),
        "hits",
        t.rounded(F.col("hits") / rank).alias("precision_at_rank"),
        t.rounded(ranking.discount(rank)).alias("discount"),
    )


@query(
    "f9_dense_ids",
    with_("SELECT at_uri, row_number() OVER (ORDER BY at_uri) - 1 AS emb_idx FROM raw_posts"),
)
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return dense_ids(t.raw_posts(spark, sf), N.POST, N.EMB).withColumn(N.EMB, F.col(N.EMB).cast("long"))


@query(
    "f9_dense_ids_orders",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS id FROM lineitem",
)
def f9_orders(spark: SparkSession, sf: str) -> DataFrame:
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return with_position(lines, [], ["l_orderkey", "l_linenumber"], "id")


@query(
    "f10_sorted_position",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders""",
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    orders = t.table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    placed = with_position(orders, [], ["o_totalprice", "o_orderkey"])
    return placed.select("o_orderkey", (F.col("position") + 1).alias("position"))


@query(
    "f10_null_order",
    """SELECT o_orderkey, row_number() OVER (ORDER BY price NULLS FIRST, o_orderkey) AS position
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price FROM orders)""",
)
def f10_nulls(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price")
    placed = with_position(t.table(spark, sf, "orders").select("o_orderkey", price), [], ["price", "o_orderkey"])
    return placed.select("o_orderkey", (F.col("position") + 1).alias("position"))


@query(
    "f11_last_value",
    with_("SELECT did, arg_max(raw_prior_count, like_hour_bucket) AS history_len FROM history GROUP BY did"),
)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return history_ops.last_history_lengths(t.history(spark, sf))


# -- sorts and top-k -------------------------------------------------------


@query("g1_capped_users", with_("SELECT did, like_count FROM trainval"))
def g1(spark: SparkSession, sf: str) -> DataFrame:
    run = t.settings(spark, sf)
    eligible = cohorts.eligible_users(t.raw_likes(spark, sf), run.min_likes)
    return cohorts.capped_users(eligible, run.max_trainval, "trainval", run.seed)


QUERY_VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def _scored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector scored against the first one."""
    vectors = t.table(spark, sf, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding")
    return vectors.withColumn("asked", first.scalar()).select(
        F.lit("m").alias("model_run_id"),
        F.format_string("%06d", "vec_id").alias(N.POST),
        F.round(dot("asked", "embedding"), 9).alias("score"),
        "label",
    )


SCORED_VECTORS = f"""SELECT printf('%06d', vec_id) AS at_uri, label,
    round(list_dot_product(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}), 9) AS score FROM embeddings"""


@query(
    "g2_global_top_k",
    with_(f"SELECT at_uri, {rnd('score')} AS score FROM sv ORDER BY sv.score DESC, at_uri LIMIT 25", sv=SCORED_VECTORS),
)
def g2(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieval.global_top_k(_scored_vectors(spark, sf), 25)
    return best.select(N.POST, t.rounded("score").alias("score"))


@query(
    "g3_top_k_with_floor",
    with_(
        """SELECT at_uri, like_count, row_number() OVER (ORDER BY score DESC, at_uri) AS rank
           FROM sv JOIN counts USING (at_uri) WHERE like_count >= 40 QUALIFY rank <= 10""",
        sv=SCORED_VECTORS,
        counts="""SELECT printf('%06d', CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS at_uri, count(*) AS like_count
                  FROM events GROUP BY ALL""",
    ),
)
def g3(spark: SparkSession, sf: str) -> DataFrame:
    events = t.table(spark, sf, "events")
    key = F.get_json_object("props", "$.k").cast("long")
    counts = events.groupBy(F.format_string("%06d", key).alias(N.POST)).agg(F.count(F.lit(1)).alias("like_count"))
    top = retrieval.top_k_with_floor(_scored_vectors(spark, sf), counts, 10, 40)
    return top.select(N.POST, "like_count", F.col("rank").cast("long").alias("rank"))


TOP_USER = "(SELECT did FROM user_counts ORDER BY like_count DESC, did LIMIT 1)"


def top_user(likes: DataFrame) -> DataFrame:
    """The user with the most likes, as a one-row table."""
    return cohorts.likes_per_user(likes).orderBy(F.col("like_count").desc(), N.USER).limit(1).select(N.USER)


@query(
    "g4_recent_likes",
    with_(f"""SELECT subject_uri, {micro('record_created_at')} AS record_created_at,
                     row_number() OVER (ORDER BY raw_likes.record_created_at DESC, subject_uri) AS rank
              FROM raw_likes WHERE did = {TOP_USER} QUALIFY rank <= 50"""),
)
def g4(spark: SparkSession, sf: str) -> DataFrame:
    likes = t.raw_likes(spark, sf)
    recent = retrieval.recent_likes(likes, top_user(likes).scalar(), 50)
    return recent.select(N.ITEM, t.micro_text(N.TS).alias(N.TS), F.col("rank").cast("long").alias("rank"))


@query(
    "g5_sorted_authors",
    """SELECT source AS author_did, lang AS model_run_id, count(*) AS count, min(doc_id) AS best_rank
       FROM documents GROUP BY ALL ORDER BY lang, count DESC, best_rank, source""",
)
def g5(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select(
        F.col("lang").alias("model_run_id"), F.col("source").alias(N.AUTHOR), F.col("doc_id").alias("rank")
    )
    return retrieval.sorted_authors(retrieval.author_concentration(docs))


# -- set operations --------------------------------------------------------


@query("h1_union_all", with_("SELECT did, like_count, user_cohort FROM cohorts"))
def h1(spark: SparkSession, sf: str) -> DataFrame:
    run, likes = t.settings(spark, sf), t.raw_likes(spark, sf)
    sampled = cohorts.sample_cohorts(likes, run.min_likes, run.max_trainval, run.max_unseen, run.seed)
    return sampled.withColumnRenamed("_user_cohort", "user_cohort")


@query("h2_union_distinct", with_(f"SELECT subject_uri, {hour('target_hour')} AS target_hour FROM needed"))
def h2(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    needed = popularity.needed_post_hours(core.sampled_likes, core.sampled_posts)
    return needed.withColumn("target_hour", t.time_text("target_hour"))


@query(
    "h3_union_dedupe",
    with_(f"""SELECT at_uri, {hour('negative_hour_bucket')} AS negative_hour_bucket, is_liked, in_random_sample
              FROM sampled_posts"""),
)
def h3(spark: SparkSession, sf: str) -> DataFrame:
    """Each part doubled first, so that the copies must go."""
    core = t.core(spark, sf).sampled_posts.drop("split_window")
    negatives, liked = core.where("in_random_sample"), core.where("NOT in_random_sample")
    combined = posts_ops.combine_posts(negatives.unionByName(negatives), liked.unionByName(liked))
    return combined.select(N.POST, t.time_text(N.NEG_HOUR).alias(N.NEG_HOUR), "is_liked", "in_random_sample")


@query(
    "h4_dedupe_by_post",
    with_(f"""SELECT subject_uri AS at_uri, {micro('min(record_created_at)')} AS record_created_at,
                     arg_min(did, (record_created_at, did)) AS did FROM raw_likes GROUP BY subject_uri"""),
)
def h4_post(spark: SparkSession, sf: str) -> DataFrame:
    copies = t.raw_likes(spark, sf).select(
        F.col(N.ITEM).alias(N.POST), N.TS, N.USER, F.col(N.ITEM).alias("record_text")
    )
    return posts_ops.unique_posts(copies).select(N.POST, t.micro_text(N.TS).alias(N.TS), N.USER)


@query(
    "h4_dedupe_by_user_post",
    with_(f"""SELECT did, subject_uri, {micro('min(record_created_at)')} AS record_created_at
              FROM raw_likes GROUP BY did, subject_uri"""),
)
def h4_pair(spark: SparkSession, sf: str) -> DataFrame:
    first = one_per_key(t.raw_likes(spark, sf), [N.USER, N.ITEM], [N.TS])
    return first.select(N.USER, N.ITEM, t.micro_text(N.TS).alias(N.TS))


@query("h4_distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def h4_rows(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


@query(
    "h6_hour_expansion",
    with_(f"""SELECT at_uri, {hour('negative_hour_bucket')} AS negative_hour_bucket, global_like_count FROM expanded"""),
)
def h6(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf).select(N.POST, t.time_text(N.NEG_HOUR).alias(N.NEG_HOUR), "global_like_count")


@query(
    "h7_candidate_dedupe",
    with_(f"""SELECT at_uri, arg_min(did, (record_created_at, did)) AS author_did,
                     {micro('min(record_created_at)')} AS record_created_at
              FROM (SELECT l.subject_uri AS at_uri, l.did, l.record_created_at FROM raw_likes l
                    JOIN post_vectors v ON v.at_uri = l.subject_uri WHERE v.embedding IS NOT NULL)
              GROUP BY at_uri"""),
)
def h7(spark: SparkSession, sf: str) -> DataFrame:
    """Posts seen once per like, as overlapping files would bring them."""
    likes = t.raw_likes(spark, sf).select(F.col(N.ITEM).alias(N.POST), F.col(N.USER).alias(N.AUTHOR), N.TS)
    vectors = t.raw_posts(spark, sf, with_vectors=True).select(N.POST, "embedding")
    unique = retrieval.unique_candidates(likes.join(vectors, N.POST))
    return unique.select(N.POST, N.AUTHOR, t.micro_text(N.TS).alias(N.TS))
