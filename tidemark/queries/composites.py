"""The composite operators over the test tables, up to the whole flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions.hashing import leading_number
from tidemark.operators import candidates as cand, comparison, coverage, evaluation, flow, history as history_ops
from tidemark.operators import inequality, likes as likes_ops, pairs as pairs_ops, popularity, posts as posts_ops
from tidemark.operators import ranking, retrieval
from tidemark.operators.cohorts import cohort_size_bound, sample_cohorts
from tidemark.plans.durable import cut
from tidemark.plans.scalars import row_of
from tidemark.queries import scored as sc
from tidemark.queries import tables as t
from tidemark.queries.aggregates import BINNED_ROWS, HISTORY_SQL, METRICS, history_text
from tidemark.queries.oracle import BATCH, END, TOP_KS, VAL, hour, listed, micro, rnd, row_metrics, with_
from tidemark.queries.predictions import predictions
from tidemark.queries.registry import query
from tidemark.queries.relational import TOP_USER, top_user
from tidemark.queries.sources import shared_folder
from tidemark.sources.tables import scan

# -- sampling and core tables ----------------------------------------------


def _cohorts(spark: SparkSession, sf: str) -> DataFrame:
    run = t.settings(spark, sf)
    return sample_cohorts(t.raw_likes(spark, sf), run.min_likes, run.max_trainval, run.max_unseen, run.seed)


@query("i1_user_cohorts", with_("SELECT user_cohort, did, like_count FROM cohorts"))
def i1(spark: SparkSession, sf: str) -> DataFrame:
    return _cohorts(spark, sf).withColumnRenamed("_user_cohort", "user_cohort")


def _likes(spark: SparkSession, sf: str) -> DataFrame:
    run = t.settings(spark, sf)
    bound = cohort_size_bound(run.max_trainval, run.max_unseen)
    return likes_ops.likes_core(
        t.raw_likes(spark, sf), _cohorts(spark, sf), run.windows, run.max_likes, run.seed, bound
    )


@query(
    "i2_likes_core",
    with_(f"""SELECT did, subject_uri, {micro('record_created_at')} AS record_created_at, split,
                     {hour('like_hour_bucket')} AS like_hour_bucket FROM sampled_likes"""),
)
def i2(spark: SparkSession, sf: str) -> DataFrame:
    return _likes(spark, sf).withColumns({N.TS: t.micro_text(N.TS), N.HOUR: t.time_text(N.HOUR)})


@query(
    "i2_likes_per_split",
    with_("""SELECT split, count(*) AS n_likes, count(DISTINCT did) AS n_users FROM sampled_likes GROUP BY split"""),
)
def i2_split(spark: SparkSession, sf: str) -> DataFrame:
    per_user = _likes(spark, sf).groupBy("split", N.USER).agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("split").agg(F.sum("n").alias("n_likes"), F.count(F.lit(1)).alias("n_users"))


POST_COLUMNS = f"""at_uri, {micro('record_created_at')} AS record_created_at, did, record_text, is_liked, in_random_sample,
                   {hour('negative_hour_bucket')} AS negative_hour_bucket"""


def _posts_text(posts: DataFrame) -> DataFrame:
    return posts.withColumns({N.TS: t.micro_text(N.TS), N.NEG_HOUR: t.time_text(N.NEG_HOUR)})


@query("i3_hourly_negatives", with_(f"SELECT {POST_COLUMNS} FROM negatives"))
def i3(spark: SparkSession, sf: str) -> DataFrame:
    run = t.settings(spark, sf)
    inside = posts_ops.post_window(t.raw_posts(spark, sf), run.windows)
    counts = popularity.candidate_counts(t.raw_likes(spark, sf), run.negative_share, run.min_negative_likes)
    liked = t.core(spark, sf).sampled_likes
    return _posts_text(
        posts_ops.hourly_negatives(inside, counts, liked, run.windows, run.negatives_per_hour, run.negative_alpha)
    )


@query("i4_posts_core", with_(f"SELECT {POST_COLUMNS}, split_window FROM sampled_posts"))
def i4(spark: SparkSession, sf: str) -> DataFrame:
    run = t.settings(spark, sf)
    counts = popularity.candidate_counts(t.raw_likes(spark, sf), run.negative_share, run.min_negative_likes)
    likes = t.core(spark, sf).sampled_likes
    return _posts_text(
        posts_ops.posts_core(
            t.raw_posts(spark, sf), counts, likes, run.windows, run.negatives_per_hour, run.negative_alpha
        )
    )


@query(
    "i5_prior_popularity",
    with_(f"SELECT subject_uri, {hour('target_hour')} AS target_hour, prior_cumulative_likes FROM prior"),
)
def i5(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    needed = popularity.needed_post_hours(core.sampled_likes, core.sampled_posts)
    prior = popularity.prior_popularity(popularity.hourly_likes(t.raw_likes(spark, sf)), needed)
    return prior.withColumn("target_hour", t.time_text("target_hour"))


@query(
    "i6_popularity_curve",
    with_(f"""SELECT emb_idx, {hour('popularity_hour_bucket')} AS popularity_hour_bucket, prior_cumulative_likes
              FROM curve"""),
)
def i6(spark: SparkSession, sf: str) -> DataFrame:
    liked = t.core(spark, sf).likes.select(N.ITEM, N.EMB).distinct()
    curve = popularity.popularity_curve(popularity.hourly_likes(t.raw_likes(spark, sf)), liked)
    return curve.withColumns({N.EMB: F.col(N.EMB).cast("long"), popularity.CURVE_HOUR: t.time_text(popularity.CURVE_HOUR)})


@query(
    "i7_reverify",
    with_(f"""SELECT did, subject_uri, {micro('record_created_at')} AS record_created_at, split FROM verified_likes"""),
)
def i7(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    kept = likes_ops.reverify(core.sampled_likes, core.posts, t.MIN_LIKES)
    return kept.select(N.USER, N.ITEM, t.micro_text(N.TS).alias(N.TS), "split")


@query("i8_user_history", HISTORY_SQL)
def i8(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    return history_text(history_ops.user_history(core.likes, core.curve, t.MAX_PRIOR))


# -- candidates ------------------------------------------------------------


CANDIDATE_COLUMNS = f"""split, {hour('like_hour_bucket')} AS like_hour_bucket, batch_id, post_id, emb_idx, author_idx,
                        prior_cumulative_likes, from_likes"""


def _candidates_text(candidates: DataFrame) -> DataFrame:
    return candidates.drop("likers").withColumns(
        {N.HOUR: t.time_text(N.HOUR), N.EMB: F.col(N.EMB).cast("long"), N.AUTHOR_IDX: F.col(N.AUTHOR_IDX).cast("long")}
    )


@query("i9_candidate_sets", with_(f"SELECT {CANDIDATE_COLUMNS} FROM candidates"))
def i9(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates_text(cand.candidate_sets(sc.batched(spark, sf), t.core(spark, sf).likes, t.core(spark, sf).posts))


@query(
    "i9_labelled_pairs",
    with_(f"SELECT split, {hour('like_hour_bucket')} AS like_hour_bucket, batch_id, did, post_id, label FROM pairs"),
)
def i9_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = sc.pairs(spark, sf)
    return pairs.select("split", t.time_text(N.HOUR).alias(N.HOUR), "batch_id", N.USER, "post_id", "label")


EXTRA, EPOCH = 3, 2


@query(
    "i10_extra_negatives",
    with_(
        f"SELECT {CANDIDATE_COLUMNS} FROM kept",
        kept=f"""SELECT *, true AS from_likes FROM batch_positives UNION ALL
                 SELECT * EXCLUDE (rn), false FROM (
                   SELECT *, row_number() OVER (PARTITION BY split, like_hour_bucket, batch_id ORDER BY
                     md5('42:extra:{EPOCH}:' || split || ':' || batch_id || ':' || post_id), post_id) AS rn
                   FROM batch_negatives) WHERE rn <= {EXTRA}""",
    ),
)
def i10(spark: SparkSession, sf: str) -> DataFrame:
    sets = cand.candidate_sets(sc.batched(spark, sf), t.core(spark, sf).likes, t.core(spark, sf).posts, EXTRA, epoch=EPOCH)
    return _candidates_text(sets)


def _batch_sql(salt: str, drop_last: bool) -> str:
    where = f"WHERE batch_id < n // {BATCH}" if drop_last else ""
    return with_(
        f"""SELECT split, did, {hour('like_hour_bucket')} AS like_hour_bucket, batch_id FROM (
              SELECT *, (row_number() OVER (PARTITION BY split, like_hour_bucket ORDER BY md5('42:{salt}:' || did), did) - 1)
                        // {BATCH} AS batch_id, count(*) OVER (PARTITION BY split, like_hour_bucket) AS n
              FROM user_hours) {where}"""
    )


def _batches(spark: SparkSession, sf: str, **options) -> DataFrame:
    hours = cand.user_hours(t.core(spark, sf).likes)
    assigned = cand.assign_batches(hours, t.BATCH, **options)
    return assigned.select("split", N.USER, t.time_text(N.HOUR).alias(N.HOUR), "batch_id")


@query("i11_batches", _batch_sql("batch", False))
def i11(spark: SparkSession, sf: str) -> DataFrame:
    return _batches(spark, sf, shuffle=False)


@query("i11_shuffled_full_batches", _batch_sql("batch:3", True))
def i11_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return _batches(spark, sf, shuffle=True, drop_last=True, epoch=3)


def _place_sql(place: str, n: str, key: str) -> str:
    """The permutation of :func:`tidemark.operators.pairs.shuffled_place` in SQL."""
    columns = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    rows = f"(({n} + {columns} - 1) // {columns})"

    def moved(at: str, size: str, other: str, step: int) -> str:
        return f"({at} + CAST('0x' || substr(md5('42:place{step}:' || {key} || ':' || {other}), 1, 8) AS BIGINT)) % {size}"

    def permuted(cell: str, mark: str) -> str:
        def turn(row: str, column: str, step: int) -> str:
            if step == pairs_ops.ROUNDS:
                return f"{row} * {columns} + {column}"
            name = f"{mark}{step}"
            if step % 2 == 0:
                return f"list_transform([{moved(row, rows, column, step)}], lambda {name}: {turn(name, column, step + 1)})[1]"
            return f"list_transform([{moved(column, columns, row, step)}], lambda {name}: {turn(row, name, step + 1)})[1]"

        return turn(f"({cell} // {columns})", f"({cell} % {columns})", 0)

    again = f"lambda v, w: CASE WHEN v < {n} THEN v ELSE {permuted('v', 'q')} END"
    return f"list_reduce(list_prepend({permuted(place, 'p')}, range({pairs_ops.WALKS})), {again})"


@query(
    "i12_pairs_dataset",
    with_(
        f"""SELECT did, at_uri, liked, {rnd('first_value')} AS first_value
            FROM (SELECT did, subject_uri AS at_uri, 1 AS liked FROM raw_likes
                  UNION ALL SELECT did, at_uri, 0 FROM walked WHERE taken <= k)
            JOIN features USING (at_uri)""",
        features="SELECT at_uri, CAST(embedding[1] AS DOUBLE) AS first_value FROM post_vectors WHERE embedding IS NOT NULL",
        numbered="SELECT at_uri, row_number() OVER (ORDER BY at_uri) - 1 AS post_no FROM features",
        positives="SELECT DISTINCT did, subject_uri AS at_uri FROM raw_likes WHERE subject_uri IN (SELECT at_uri FROM features)",
        stops=f"""SELECT did, k, i, {_place_sql('i', 'n', 'did')} AS post_no
                  FROM (SELECT did, k, n, unnest(range(least(2 * k, n))) AS i
                        FROM (SELECT did, count(*) AS k, (SELECT count(*) FROM features) AS n FROM positives GROUP BY did))""",
        walked="""SELECT did, at_uri, k, row_number() OVER (PARTITION BY did ORDER BY i) AS taken
                  FROM stops JOIN numbered USING (post_no)
                  WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.did = stops.did AND p.at_uri = numbered.at_uri)""",
    ),
)
def i12(spark: SparkSession, sf: str) -> DataFrame:
    features = (
        t.raw_posts(spark, sf, with_vectors=True)
        .where(F.col("embedding").isNotNull())
        .select(N.POST, t.rounded(F.element_at("embedding", 1)).alias("first_value"))
    )
    return pairs_ops.pairs_dataset(t.raw_likes(spark, sf), features)


# -- ranking ---------------------------------------------------------------


RANK_NAMES = ranking.metric_names(TOP_KS)


def _means_sql(where: str, prefix: str = "") -> str:
    means = ", ".join(f"{rnd(f'coalesce(avg({m}), 0)')} AS {prefix}{m}" for m in RANK_NAMES)
    return f"""SELECT split, {means}, {rnd('coalesce(avg(strict_average_precision), 0)')} AS {prefix}mean_average_precision,
                      count(*) AS {prefix}rank_metric_user_count
               FROM ranking_rows WHERE {where} GROUP BY split"""


def _round_all(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: t.rounded(c) for c in df.columns if c not in keep and not c.endswith("count")})


@query("i13_rank_metrics", with_(_means_sql("positive_count > 0")))
def i13(spark: SparkSession, sf: str) -> DataFrame:
    return _round_all(ranking.rank_metrics(sc.rows(spark, sf), ["split"], TOP_KS), ("split",))


def _baseline_sql() -> str:
    parts = []
    for k in TOP_KS:
        cut = f"least({k}, candidate_count)"
        gain = f"list_sum(list_transform(range(1, CAST({cut} AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))"
        ideal = f"list_sum(list_transform(range(1, CAST(least(positive_count, {cut}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))"
        dcg = f"(positive_count / candidate_count * {gain})"
        parts += [f"{rnd(f'avg({dcg})')} AS dcg_at_{k}", f"{rnd(f'avg({dcg} / {ideal})')} AS ndcg_at_{k}",
                  f"{rnd(f'avg({cut} / candidate_count)')} AS recall_at_{k}"]
    harmonic = "list_sum(list_transform(range(1, candidate_count + 1), lambda i: 1 / i))"
    ap = f"""CASE WHEN candidate_count = 1 THEN 1 ELSE ({harmonic} + (candidate_count - {harmonic})
             * (positive_count - 1) / (candidate_count - 1)) / candidate_count END"""
    return f"""SELECT split, {', '.join(parts)}, {rnd(f'avg({ap})')} AS mean_average_precision,
                      count(*) AS rank_metric_user_count FROM ranking_rows WHERE positive_count > 0 GROUP BY split"""


@query("i14_random_baseline", with_(_baseline_sql()))
def i14(spark: SparkSession, sf: str) -> DataFrame:
    return _round_all(ranking.random_baseline(sc.rows(spark, sf), ["split"], TOP_KS), ("split",))


@query(
    "i15_zero_history",
    with_(_means_sql("positive_count > 0 AND num_embedding_likes = 0", ranking.ZERO_HISTORY)),
)
def i15(spark: SparkSession, sf: str) -> DataFrame:
    return _round_all(ranking.zero_history_metrics(sc.rows(spark, sf), ["split"], TOP_KS), ("split",))


ROW_FLOATS = [
    "positive_rank_min", "positive_rank_mean", "positive_rank_max", "strict_average_precision", "average_precision",
    "auc_roc", *RANK_NAMES,
]


@query(
    "i16_ranking_rows",
    with_(f"""SELECT split, {hour('like_hour_bucket')} AS like_hour_bucket, batch_id, did, num_embedding_likes,
                     num_total_likes, candidate_count, positive_count, {', '.join(f'{rnd(c)} AS {c}' for c in ROW_FLOATS)}
              FROM ranking_rows"""),
)
def i16(spark: SparkSession, sf: str) -> DataFrame:
    rows = sc.fresh_rows(spark, sf)
    return rows.withColumns({N.HOUR: t.time_text(N.HOUR), **{c: t.rounded(c) for c in ROW_FLOATS}})


PAIR_KEYS = ["split", "like_hour_bucket", "did", "post_id"]
POOLED_SQL = f"""
    SELECT (SELECT count(*) FROM scores) AS classification_metric_pair_count,
           (SELECT CAST(sum(label) AS BIGINT) FROM scores) AS classification_metric_positive_count,
           count(*) AS classification_metric_sampled_pair_count,
           count(*) < (SELECT count(*) FROM scores) AS classification_metric_sampled,
           {rnd('''(sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
                   / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))''')} AS auc_roc,
           {rnd('avg(pos_down / n_down) FILTER (label = 1)')} AS classification_average_precision
    FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r,
                 sum(label) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS pos_down,
                 count(*) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS n_down FROM drawn)"""
DRAWN = f"""
    SELECT label, round(score, 9) AS score FROM (
      SELECT *, row_number() OVER (ORDER BY md5('42:pairs:' || split || ':' || {hour('like_hour_bucket')} || ':' || did || ':' || post_id),
                                   split, like_hour_bucket, did, post_id) AS rn FROM scores)"""


def _pooled(spark: SparkSession, sf: str, max_pairs: int | None) -> DataFrame:
    pairs = sc.scored(spark, sf).withColumns({"score": F.round("score", 9), N.HOUR: t.time_text(N.HOUR)})
    pooled = ranking.pooled_classification(pairs, PAIR_KEYS, max_pairs)
    return pooled.withColumns({c: t.rounded(c) for c in ("auc_roc", "classification_average_precision")})


@query("i17_pooled_classification", with_(POOLED_SQL, drawn=DRAWN))
def i17(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf, None)


@query("i17_sampled_classification", with_(POOLED_SQL, drawn=DRAWN + " WHERE rn <= 20000"))
def i17_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf, 20_000)


@query(
    "i18_listwise_loss",
    with_(f"""SELECT {rnd('avg(lse - hit / p)')} AS loss, count(*) AS n_rows FROM (
                SELECT ln(sum(exp(score))) AS lse, sum(label) AS p, sum(label * score) AS hit
                FROM scores GROUP BY split, like_hour_bucket, batch_id, did)"""),
)
def i18(spark: SparkSession, sf: str) -> DataFrame:
    loss = ranking.listwise_loss(sc.scored(spark, sf), sc.KEYS)
    return loss.withColumn("loss", t.rounded("loss"))


# -- evaluation ------------------------------------------------------------


@query(
    "i19_cold_start",
    with_(
        f"""SELECT r.bin, r.n_ranking_rows, r.n_users, {', '.join(f'{rnd(f"r.{m}")} AS {m}' for m in METRICS)},
                   s.total_rows, s.total_users, {rnd('s.mean_history')} AS mean_history
            FROM binned_rows r, (SELECT count(*) AS total_rows, count(DISTINCT did) AS total_users,
                                        avg(num_embedding_likes) AS mean_history FROM ranking_rows) s""",
        binned_rows=BINNED_ROWS,
    ),
)
def i19(spark: SparkSession, sf: str) -> DataFrame:
    """Cold-start table with the totals of the analysis on each line."""
    rows = sc.rows(spark, sf)
    table = evaluation.binned_ranking(rows, METRICS).withColumn("_all", row_of(evaluation.history_totals(rows)))
    return table.select(
        "bin",
        "n_ranking_rows",
        "n_users",
        *[t.rounded(m).alias(m) for m in METRICS],
        "_all.total_rows",
        "_all.total_users",
        t.rounded(F.col("_all.mean_history")).alias("mean_history"),
    )


PREDICTION_VALUES = """
    SELECT 'accuracy' AS metric, did, count(*) FILTER ((y_true = 1) = (y_pred_proba > 0.5)) / count(*) AS value
    FROM predictions GROUP BY did
    UNION ALL
    SELECT 'recall', did, coalesce(count(*) FILTER (y_true = 1 AND y_pred_proba > 0.5)
                                   / nullif(count(*) FILTER (y_true = 1), 0), 0) FROM predictions GROUP BY did"""


@query(
    "i20_performance_inequality",
    with_(
        f"""SELECT metric, {rnd('''CASE WHEN sum(value) = 0 THEN 0 ELSE 2 * sum(i * value) / (max(n) * sum(value))
                   - (max(n) + 1) / max(n) END''')} AS gini, count(*) AS n_users, {rnd('avg(value)')} AS mean,
                   {rnd('stddev_pop(value)')} AS std, {rnd('quantile_cont(value, 0.5)')} AS median,
                   {rnd('min(value)')} AS min, {rnd('max(value)')} AS max
            FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, did) AS i,
                         count(*) OVER (PARTITION BY metric) AS n FROM vals) GROUP BY metric""",
        vals=PREDICTION_VALUES,
    ),
)
def i20(spark: SparkSession, sf: str) -> DataFrame:
    """Inequality of the per-user classification metrics; the ranking side is e18 and e20."""
    per_user = evaluation.per_user_classification(predictions(spark, sf))
    summary = inequality.inequality_summary(inequality.long_metrics(per_user, ["accuracy", "recall"]))
    return summary.withColumns({c: t.rounded(c) for c in ("gini", "mean", "std", "median", "min", "max")})


# -- retrieval -------------------------------------------------------------


RECENT, K, FLOOR = 50, 20, 3
RETRIEVAL = {
    "recent": f"""SELECT subject_uri, row_number() OVER (ORDER BY raw_likes.record_created_at DESC, subject_uri) AS rank
                  FROM raw_likes WHERE did = {TOP_USER} QUALIFY rank <= {RECENT}""",
    "entries": """SELECT rank, embedding, row_number() OVER (ORDER BY rank) - 1 AS i
                  FROM recent JOIN post_vectors ON at_uri = subject_uri WHERE embedding IS NOT NULL""",
    "weights": """SELECT 'mean' AS model_run_id, i, embedding, 1.0 AS w FROM entries
                  UNION ALL SELECT 'ema', i, embedding, 0.1 * pow(0.9, i) FROM entries""",
    "user_vectors": """SELECT model_run_id, list(v ORDER BY d) AS vec FROM (
                         SELECT model_run_id, d, sum(w * x) / sum(w) AS v FROM (
                           SELECT model_run_id, w, unnest(CAST(embedding AS DOUBLE[])) AS x,
                                  generate_subscripts(embedding, 1) AS d FROM weights)
                         GROUP BY model_run_id, d) GROUP BY model_run_id""",
    "pool": f"""SELECT at_uri, did AS author_did, embedding FROM post_vectors
                WHERE embedding IS NOT NULL AND record_created_at >= {VAL} AND record_created_at < {END}""",
    "sp": """SELECT model_run_id, at_uri, author_did, round(list_dot_product(vec, CAST(embedding AS DOUBLE[])), 9) AS score
             FROM pool JOIN user_vectors ON true""",
    "top_posts": f"""SELECT model_run_id, at_uri, author_did, score, like_count,
                            row_number() OVER (PARTITION BY model_run_id ORDER BY score DESC, at_uri) AS rank
                     FROM sp JOIN (SELECT subject_uri AS at_uri, count(*) AS like_count FROM raw_likes GROUP BY ALL)
                     USING (at_uri) WHERE like_count >= {FLOOR} QUALIFY rank <= {K}""",
}


class Retrieval:
    """The retrieval run of the most active user, with a mean and an EMA user vector."""

    def __init__(self, spark: SparkSession, sf: str):
        likes = t.raw_likes(spark, sf)
        posts = t.raw_posts(spark, sf, with_vectors=True)
        recent = retrieval.recent_likes(likes, top_user(likes).scalar(), RECENT)
        self.history = cut(retrieval.history_posts(recent, posts, posts.select(N.POST, "embedding"), t.DIM))
        users = {kind: retrieval.user_vector(self.history, t.DIM, kind) for kind in ("mean", "ema")}
        window = posts.where(
            (F.col(N.TS) >= F.lit(t.WINDOWS.val_start).cast("timestamp"))
            & (F.col(N.TS) < F.lit(t.WINDOWS.holdout_end).cast("timestamp"))
        ).withColumnRenamed(N.USER, N.AUTHOR)
        self.pool = window
        scores = retrieval.unique_scored(retrieval.score_posts(window, users, t.DIM))
        scores = scores.withColumn("score", F.round("score", 9))
        counts = likes.groupBy(F.col(N.ITEM).alias(N.POST)).agg(F.count(F.lit(1)).alias("like_count"))
        self.top = retrieval.top_k_with_floor(scores, counts, K, FLOOR)


@query(
    "i21_retrieval",
    with_(f"SELECT model_run_id, at_uri, author_did, {rnd('score')} AS score, like_count, rank FROM top_posts", **RETRIEVAL),
)
def i21(spark: SparkSession, sf: str) -> DataFrame:
    top = Retrieval(spark, sf).top
    return top.select(
        "model_run_id", N.POST, N.AUTHOR, t.rounded("score").alias("score"), "like_count", F.col("rank").cast("long").alias("rank")
    )


@query(
    "e30_author_concentration",
    with_("""SELECT model_run_id, author_did, count(*) AS count, min(rank) AS best_rank FROM top_posts GROUP BY ALL""",
          **RETRIEVAL),
)
def e30(spark: SparkSession, sf: str) -> DataFrame:
    counts = retrieval.author_concentration(Retrieval(spark, sf).top)
    return counts.withColumn("best_rank", F.col("best_rank").cast("long"))


@query(
    "e31_retrieval_summary",
    with_(
        f"""SELECT model_run_id, count(*) AS top_k_returned, {rnd('min(score)')} AS score_min, {rnd('max(score)')} AS score_max,
                   (SELECT count(*) FROM pool) AS n_candidate_posts_scanned, (SELECT count(*) FROM recent) AS n_history_likes,
                   (SELECT count(*) FROM entries) AS n_embeddable_history_posts
            FROM top_posts GROUP BY model_run_id""",
        **RETRIEVAL,
    ),
)
def e31(spark: SparkSession, sf: str) -> DataFrame:
    run = Retrieval(spark, sf)
    summary = retrieval.retrieval_summary(run.top, run.pool, run.history)
    return summary.withColumns({c: t.rounded(c) for c in ("score_min", "score_max")})


# -- comparison ------------------------------------------------------------


MODELS = {"by_popularity": ("popularity", "popularity"), "by_mean": ("dot", "dot_mean"), "by_ema": ("dot", "dot_ema")}
MODEL_KEYS = "model_name, model_type, split, like_hour_bucket, batch_id, did"


def _model_ctes(max_pairs: int | None) -> dict[str, str]:
    weighted = """
        SELECT did, like_hour_bucket, d, sum(x) / count(*) AS mean_v,
               sum(x * 0.1 * pow(0.9, pos - 1)) / sum(0.1 * pow(0.9, pos - 1)) AS ema_v
        FROM (SELECT e.did, e.like_hour_bucket, e.pos, unnest(CAST(m.embedding AS DOUBLE[])) AS x,
                     generate_subscripts(m.embedding, 1) AS d
              FROM history_entries e JOIN emb_table m USING (emb_idx))
        GROUP BY did, like_hour_bucket, d"""
    zeros = f"list_transform(range({t.DIM}), lambda i: CAST(0 AS DOUBLE))"
    return {
        "weighted": weighted,
        "uv": """SELECT did, like_hour_bucket, list(mean_v ORDER BY d) AS mean_vec, list(ema_v ORDER BY d) AS ema_vec
                 FROM weighted GROUP BY did, like_hour_bucket""",
        "vp": f"""SELECT p.split, p.like_hour_bucket, p.batch_id, p.did, p.post_id, p.label, least(h.n_prior, 20) AS n_prior,
                         ln(1 + p.prior_cumulative_likes) AS popularity,
                         round(list_dot_product(coalesce(u.mean_vec, {zeros}), CAST(m.embedding AS DOUBLE[])), 9) + 0.0 AS dot_mean,
                         round(list_dot_product(coalesce(u.ema_vec, {zeros}), CAST(m.embedding AS DOUBLE[])), 9) + 0.0 AS dot_ema
                  FROM pairs p JOIN emb_table m USING (emb_idx) JOIN history h USING (did, like_hour_bucket)
                  LEFT JOIN uv u USING (did, like_hour_bucket)""",
        "ms": " UNION ALL ".join(
            f"""SELECT '{name}' AS model_name, '{kind}' AS model_type, split, like_hour_bucket, batch_id, did, post_id, label,
                       n_prior, {col} AS score FROM vp"""
            for name, (kind, col) in MODELS.items()
        ),
        "mr": f"""SELECT *, row_number() OVER r AS rank, sum(label) OVER (r ROWS UNBOUNDED PRECEDING) AS hits,
                         count(*) OVER g AS n, sum(label) OVER g AS p, count(*) OVER s AS n_down_to,
                         sum(label) OVER s AS pos_down_to, count(*) OVER t AS n_same, sum(label) OVER t AS pos_same
                  FROM ms WINDOW g AS (PARTITION BY {MODEL_KEYS}),
                       r AS (PARTITION BY {MODEL_KEYS} ORDER BY score DESC, post_id),
                       s AS (PARTITION BY {MODEL_KEYS} ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                       t AS (PARTITION BY {MODEL_KEYS}, score)""",
        "mrows": row_metrics("mr", MODEL_KEYS, "max(n_prior) AS n_prior, ln(sum(exp(score))) - sum(label * score) / max(p) AS loss,"),
        "draws": f"""SELECT *, row_number() OVER (PARTITION BY model_name, split ORDER BY
                              md5('42:pairs:' || split || ':' || {hour('like_hour_bucket')} || ':' || batch_id || ':' || did || ':' || post_id)) AS rn FROM ms""",
        "pooled": f"""SELECT model_name, model_type, split, count(*) AS n_pairs,
                            (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2)
                              / (sum(label) * (count(*) - sum(label))) AS auc_roc,
                            avg(pos_down / n_down) FILTER (label = 1) AS ap
                     FROM (SELECT *, rank() OVER (PARTITION BY model_name, split ORDER BY score)
                                     + (count(*) OVER (PARTITION BY model_name, split, score) - 1) / 2 AS r,
                                  sum(label) OVER (PARTITION BY model_name, split ORDER BY score DESC
                                                   RANGE UNBOUNDED PRECEDING) AS pos_down,
                                  count(*) OVER (PARTITION BY model_name, split ORDER BY score DESC
                                                 RANGE UNBOUNDED PRECEDING) AS n_down
                           FROM draws{f" WHERE rn <= {max_pairs}" if max_pairs else ""})
                     GROUP BY ALL""",
        "all_pairs": "SELECT model_name, model_type, split, count(*) AS n_all, sum(label) AS p FROM ms GROUP BY ALL",
        **{name: f"""SELECT model_name, model_type, split, {', '.join(f'avg({m}) AS {m}' for m in RANK_NAMES)},
                            avg(strict_average_precision) AS mean_average_precision, count(*) AS rank_metric_user_count, avg(loss) AS loss
                     FROM mrows WHERE positive_count > 0 {which} GROUP BY model_name, model_type, split"""
           for name, which in (("mm", ""), ("zm", "AND n_prior = 0"))},
    }


def _compare_sql(max_pairs: int | None = None) -> str:
    keys = "model_name, model_type, split"
    ranks = [*RANK_NAMES, "mean_average_precision", "rank_metric_user_count"]
    parts = [f"SELECT {keys}, '{m}' AS metric, {rnd(m, 5)} AS value FROM mm" for m in [*ranks, "loss"]]
    parts += [f"SELECT {keys}, 'zero_history_{m}', {rnd(f'coalesce(z.{m}, 0)', 5)} FROM mm LEFT JOIN zm z USING ({keys})" for m in ranks]
    pooled = {"auc_roc": "auc_roc", "classification_average_precision": "ap", "classification_metric_pair_count": "n_all",
              "classification_metric_positive_count": "p", "classification_metric_sampled_pair_count": "n_pairs",
              "classification_metric_sampled": "CASE WHEN n_all > n_pairs THEN 1 ELSE 0 END"}
    parts += [f"SELECT {keys}, '{m}', {rnd(c, 5)} FROM pooled JOIN all_pairs USING ({keys})" for m, c in pooled.items()]
    return with_(" UNION ALL ".join(parts), **_model_ctes(max_pairs))


SAMPLED_PAIRS = 2000


def _compared(spark: SparkSession, sf: str, max_pairs: int | None = None) -> DataFrame:
    # Times enter the draw as text.
    pairs = sc.vector_pairs(spark, sf).withColumn(N.HOUR, t.time_text(N.HOUR))
    return comparison.compare_models(pairs, MODELS, sc.KEYS, TOP_KS, max_pairs=max_pairs).withColumn("value", t.rounded("value", 5))


@query("i22_sampled_comparison", _compare_sql(SAMPLED_PAIRS))
def i22_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """The comparison with classification over a draw of pairs from each split."""
    return _compared(spark, sf, SAMPLED_PAIRS)


@query("i22_model_comparison", _compare_sql())
def i22(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf)


N_TARGETS, N_PRIOR = 100, 5


@query(
    "i23_prior_like_sample",
    with_(
        f"""SELECT g.did, g.target_uri, count(p.emb_idx) AS n_prior, coalesce(string_agg(p.emb_idx, ',' ORDER BY p.pos), '') AS prior,
                   {rnd('coalesce(avg(p.s), 0)')} AS vector_sum
            FROM targets g LEFT JOIN priors p ON p.did = g.did AND p.target_uri = g.target_uri AND p.pos <= {N_PRIOR}
            GROUP BY g.did, g.target_uri""",
        targets=f"""SELECT did, subject_uri AS target_uri, record_created_at AS target_ts FROM (
                      SELECT *, row_number() OVER (ORDER BY md5('42:target:' || did || ':' || subject_uri || ':'
                                                   || epoch_us(record_created_at)), did, subject_uri) AS rn
                      FROM (SELECT *, row_number() OVER (PARTITION BY did ORDER BY record_created_at, emb_idx) AS o FROM likes_core)
                      WHERE o > 1) WHERE rn <= {N_TARGETS}""",
        priors="""SELECT g.did, g.target_uri, l.emb_idx,
                         list_sum(list_transform(m.embedding, lambda x: CAST(x AS DOUBLE))) AS s,
                         row_number() OVER (PARTITION BY g.did, g.target_uri
                                            ORDER BY l.record_created_at DESC, l.emb_idx DESC) AS pos
                  FROM targets g JOIN likes_core l ON l.did = g.did AND l.record_created_at < g.target_ts
                  JOIN emb_table m USING (emb_idx)""",
    ),
)
def i23(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    targets = retrieval.sampled_prior_likes(core.likes, N_TARGETS, N_PRIOR)
    means = retrieval.mean_prior_vectors(targets, core.embeddings, t.DIM)
    total = F.aggregate("mean_vector", F.lit(0.0), lambda a, x: a + x)
    return (
        targets.join(means, [N.USER, "target_uri", "target_ts"])
        .select(
            N.USER,
            "target_uri",
            F.col("n_prior").cast("long").alias("n_prior"),
            t.list_text("prior_emb_indices").alias("prior"),
            t.rounded(total).alias("vector_sum"),
        )
    )


@query(
    "i24_source_comparison",
    with_(
        f"""SELECT s.*, c.has_embeddings, c.n_rows, c.null_rate, c.min_length, c.max_length
            FROM (SELECT source, CAST(sum(count) AS BIGINT) AS total_records, {hour('min(hour)')} AS min_hour,
                         {hour('max(hour)')} AS max_hour, count(*) AS hours_with_data,
                         {rnd('sum(count) / count(*)')} AS avg_per_hour
                  FROM (SELECT 'likes' AS source, date_trunc('hour', record_created_at) AS hour, count(*) AS count
                        FROM raw_likes GROUP BY ALL
                        UNION ALL SELECT 'posts', date_trunc('hour', record_created_at), count(*) FROM post_vectors GROUP BY ALL)
                  GROUP BY source) s
            JOIN (SELECT 'posts' AS source, true AS has_embeddings, count(*) AS n_rows,
                         {rnd('avg(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END)')} AS null_rate,
                         CAST(min(len(embedding)) AS DOUBLE) AS min_length, CAST(max(len(embedding)) AS DOUBLE) AS max_length
                  FROM post_vectors
                  UNION ALL SELECT 'likes', false, 0, NULL, NULL, NULL) c USING (source)"""
    ),
)
def i24(spark: SparkSession, sf: str) -> DataFrame:
    posts = t.raw_posts(spark, sf, with_vectors=True).withColumnRenamed("embedding", "embeddings")
    compared = coverage.compare_sources({"likes": t.raw_likes(spark, sf), "posts": posts})
    return compared.withColumns(
        {
            "min_hour": t.time_text("min_hour"),
            "max_hour": t.time_text("max_hour"),
            "avg_per_hour": t.rounded("avg_per_hour"),
            "null_rate": t.rounded("null_rate"),
            "min_length": F.col("min_length").cast("double"),
            "max_length": F.col("max_length").cast("double"),
        }
    )


# -- the whole flow --------------------------------------------------------


#: Columns of the written tables that enter a row's digest; times, vectors and lists as text.
FLOW_COLUMNS = {
    "likes_core": ["did", "subject_uri", "micro:record_created_at", "split", "hour:like_hour_bucket", "prior_cumulative_likes", "emb_idx",
                   "author_did", "author_idx"],
    "posts_core": ["at_uri", "micro:record_created_at", "did", "record_text", "flag:is_liked", "flag:in_random_sample",
                   "hour:negative_hour_bucket", "split_window", "prior_cumulative_likes", "emb_idx", "author_idx"],
    "author_idx": ["author_did", "author_train_count", "author_idx"],
    "liked_post_hour_cumulative_likes": ["emb_idx", "hour:popularity_hour_bucket", "prior_cumulative_likes"],
    "embeddings": ["at_uri", "emb_idx", "vector:embedding"],
    "history": ["did", "hour:like_hour_bucket", "raw_prior_count", "list:prior_emb_indices", "list:prior_cumulative_likes",
                "list:prior_author_indices"],
}
FLOW_SOURCES = {"author_idx": "authors", "liked_post_hour_cumulative_likes": "curve", "embeddings": "emb_table"}


def _cell_sql(column: str) -> str:
    kind, _, name = column.rpartition(":")
    text = {
        "": f"CAST({name} AS VARCHAR)",
        "micro": micro(name),
        "hour": hour(name),
        "flag": f"CASE WHEN {name} THEN 'yes' ELSE 'no' END",
        "list": listed(name),
        "vector": f"CAST(CAST(round(list_sum(list_transform({name}, lambda x: CAST(x AS DOUBLE))) * 10000) AS BIGINT) AS VARCHAR)",
    }[kind]
    return f"coalesce({text}, '-')"


def _cell(column: str) -> Column:
    kind, _, name = column.rpartition(":")
    if kind == "vector":
        total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x.cast("double"))
        text = F.round(total * 10000).cast("long").cast("string")
    elif kind == "list":
        text = t.list_text(name)
    elif kind == "flag":
        text = F.when(F.col(name), "yes").otherwise("no")
    elif kind:
        text = t.micro_text(name) if kind == "micro" else t.time_text(name)
    else:
        text = F.col(name).cast("string")
    return F.coalesce(text, F.lit("-"))


@query(
    "i25_full_flow",
    with_(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS name, count(*) AS n_rows,
                       CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(map(_cell_sql, columns))})), 1, 8) AS BIGINT)) AS BIGINT) AS digest
                FROM {FLOW_SOURCES.get(name, name)}"""
            for name, columns in FLOW_COLUMNS.items()
        )
    ),
)
def i25(spark: SparkSession, sf: str) -> DataFrame:
    """Build everything from the raw tables with encoded vectors, write it, and digest every row of what was written."""
    folder = shared_folder(spark, "flow")
    core = t.build_core(spark, sf, folder, encoded=True)
    history = history_ops.user_history(core.likes, core.curve, t.MAX_PRIOR)
    flow.write_and_read(history, f"{folder}/history")
    out = None
    for name, columns in FLOW_COLUMNS.items():
        digest = leading_number(F.md5(F.concat_ws("|", *map(_cell, columns)))).cast("long")
        part = scan(spark, f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).alias("digest"))
        part = part.select(F.lit(name).alias("name"), "n_rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out
