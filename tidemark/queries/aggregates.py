"""Aggregations over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.operators import authors, candidates as cand, cohorts, coverage, evaluation, history as history_ops
from tidemark.operators import inequality, popularity, posts as posts_ops, profile, ranking
from tidemark.operators import likes as likes_ops
from tidemark.queries import scored as sc
from tidemark.queries import tables as t
from tidemark.queries.oracle import AUTHOR_SUPPORT, hour, listed, rnd, with_
from tidemark.queries.predictions import predictions
from tidemark.queries.registry import query
from tidemark.queries.scalars import BIN_SQL, labelled

METRICS = ["ndcg_at_5", "recall_at_30", "average_precision", "auc_roc"]


@query("e1_totals", with_("SELECT count(DISTINCT did) AS n_users, count(*) AS n_likes FROM raw_likes"))
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.totals(t.raw_likes(spark, sf))


@query("e2_likes_per_user", with_("SELECT did, like_count FROM user_counts"))
def e2(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.likes_per_user(t.raw_likes(spark, sf))


@query(
    "e2_likes_per_user_orders",
    """SELECT CAST(o_custkey AS VARCHAR) AS did, count(*) AS like_count
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def e2_orders(spark: SparkSession, sf: str) -> DataFrame:
    return cohorts.likes_per_user(t.orders_likes(spark, sf))


@query("e3_candidate_counts", with_("SELECT subject_uri, global_like_count FROM sampled_counts"))
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return popularity.sampled_like_counts(t.raw_likes(spark, sf), t.NEGATIVE_SHARE)


@query(
    "e3_candidate_stats",
    with_(f"""SELECT count(*) AS n_posts_before_min, CAST(sum(global_like_count) AS BIGINT) AS n_likes_before_min,
                     count(*) FILTER (global_like_count >= {t.MIN_NEGATIVE_LIKES}) AS n_posts,
                     CAST(sum(global_like_count) FILTER (global_like_count >= {t.MIN_NEGATIVE_LIKES}) AS BIGINT) AS n_likes
              FROM sampled_counts"""),
)
def e3_stats(spark: SparkSession, sf: str) -> DataFrame:
    counts = popularity.sampled_like_counts(t.raw_likes(spark, sf), t.NEGATIVE_SHARE)
    return popularity.candidate_stats(counts, t.MIN_NEGATIVE_LIKES)


@query("e4_hourly_likes", with_(f"SELECT subject_uri, {hour('like_hour')} AS like_hour, likes_this_hour FROM hourly"))
def e4(spark: SparkSession, sf: str) -> DataFrame:
    hourly = popularity.hourly_likes(t.raw_likes(spark, sf))
    return hourly.withColumn("like_hour", t.time_text("like_hour"))


@query(
    "e5_hourly_coverage",
    f"SELECT {hour('''date_trunc('hour', ts)''')} AS hour, count(*) AS count FROM events GROUP BY ALL ORDER BY 1",
)
def e5(spark: SparkSession, sf: str) -> DataFrame:
    hourly = coverage.hourly_counts(t.table(spark, sf, "events"), "ts")
    return hourly.orderBy("hour").withColumn("hour", t.time_text("hour"))


SOURCES_SQL = """
    SELECT 'likes' AS source, date_trunc('hour', record_created_at) AS hour, count(*) AS count FROM raw_likes GROUP BY ALL
    UNION ALL
    SELECT 'orders', date_trunc('hour', o_orderdate), count(*) FROM orders GROUP BY ALL"""


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    orders = t.table(spark, sf, "orders").select(F.col("o_orderdate").alias(N.TS))
    return coverage.sources_hourly({"likes": t.raw_likes(spark, sf), "orders": orders})


@query(
    "e6_daily_coverage",
    with_(
        """SELECT strftime(hour, '%Y-%m-%d') AS date,
                  CAST(coalesce(sum(count) FILTER (source = 'likes'), 0) AS BIGINT) AS likes,
                  CAST(coalesce(sum(count) FILTER (source = 'orders'), 0) AS BIGINT) AS orders
           FROM by_hour GROUP BY ALL""",
        by_hour=SOURCES_SQL,
    ),
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    daily = coverage.daily_comparison(_sources(spark, sf), ["likes", "orders"])
    return daily.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "e7_coverage_summary",
    with_(
        f"""SELECT source, CAST(sum(count) AS BIGINT) AS total_records, {hour('min(hour)')} AS min_hour,
                   {hour('max(hour)')} AS max_hour, count(*) AS hours_with_data, {rnd('sum(count) / count(*)')} AS avg_per_hour
            FROM by_hour GROUP BY source""",
        by_hour=SOURCES_SQL,
    ),
)
def e7(spark: SparkSession, sf: str) -> DataFrame:
    summary = coverage.coverage_summary(_sources(spark, sf))
    return summary.withColumns(
        {
            "min_hour": t.time_text("min_hour"),
            "max_hour": t.time_text("max_hour"),
            "avg_per_hour": t.rounded("avg_per_hour"),
        }
    )


@query(
    "e8_file_density",
    """SELECT CAST(sum(n) AS BIGINT) AS total_files, count(*) AS days_with_data,
              date_diff('day', min(d), max(d)) + 1 AS expected_days,
              date_diff('day', min(d), max(d)) + 1 - count(*) AS missing_days,
              round(avg(n), 1) AS mean_files_per_day, min(n) AS min_files_per_day, max(n) AS max_files_per_day
       FROM (SELECT CAST(stamp AS DATE) AS d, count(*) AS n
             FROM (SELECT DISTINCT date_trunc('hour', ts) AS stamp FROM events
                   UNION SELECT DISTINCT o_orderdate FROM orders) GROUP BY d)""",
)
def e8(spark: SparkSession, sf: str) -> DataFrame:
    """Each hour with data stands for one hourly file."""
    stamps = _sources(spark, sf).select(F.col("hour").alias("stamp")).distinct()
    return coverage.file_density(stamps)


HISTORY_SQL = with_(
    f"""SELECT did, {hour('like_hour_bucket')} AS like_hour_bucket, {listed('prior_emb_indices')} AS prior_emb_indices,
               {listed('age_seconds')} AS prior_ages, {listed('prior_cumulative_likes')} AS prior_cumulative_likes,
               {listed('prior_author_indices')} AS prior_author_indices, raw_prior_count
        FROM history"""
)


def history_text(history: DataFrame) -> DataFrame:
    ages = F.transform(
        "prior_like_age_hours_at_bucket_start", lambda a: F.round(a.cast("double") * 3600).cast("long")
    )
    return history.select(
        N.USER,
        t.time_text(N.HOUR).alias(N.HOUR),
        t.list_text("prior_emb_indices").alias("prior_emb_indices"),
        t.list_text(ages).alias("prior_ages"),
        t.list_text(N.PRIOR).alias(N.PRIOR),
        t.list_text("prior_author_indices").alias("prior_author_indices"),
        "raw_prior_count",
    )


@query("e9_history_lists", HISTORY_SQL)
def e9(spark: SparkSession, sf: str) -> DataFrame:
    return history_text(t.history(spark, sf))


@query(
    "e10_positives_per_user_hour",
    with_(f"""SELECT split, did, {hour('like_hour_bucket')} AS like_hour_bucket,
                     {listed('list(subject_uri ORDER BY record_created_at, subject_uri)')} AS liked_post_ids,
                     {listed('list(emb_idx ORDER BY record_created_at, subject_uri)')} AS liked_post_emb_indices,
                     {listed('list(prior_cumulative_likes ORDER BY record_created_at, subject_uri)')}
                       AS liked_post_prior_cumulative_likes,
                     {listed('list(coalesce(author_idx, 1) ORDER BY record_created_at, subject_uri)')}
                       AS liked_post_author_indices
              FROM likes_core GROUP BY split, did, like_hour_bucket"""),
)
def e10(spark: SparkSession, sf: str) -> DataFrame:
    lists = cand.liked_lists(t.core(spark, sf).likes)
    names = [c for c in lists.columns if c.startswith("liked_post")]
    return lists.withColumns({N.HOUR: t.time_text(N.HOUR), **{c: t.list_text(c) for c in names}})


@query("e11_author_index", with_("SELECT author_did, author_train_count, author_idx FROM authors"))
def e11(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    index = authors.author_index(core.posts, core.likes, t.AUTHOR_SUPPORT)
    return index.withColumn(N.AUTHOR_IDX, F.col(N.AUTHOR_IDX).cast("long"))


@query(
    "e11_author_stats",
    with_(f"""SELECT CAST(sum(n_sampled) AS BIGINT) AS n_author_random_train_exposures,
                     CAST(sum(n_liked) AS BIGINT) AS n_author_like_train_exposures,
                     CAST(sum(n_sampled + n_liked) AS BIGINT) AS n_author_train_exposures,
                     count(*) AS n_authors_with_train_support,
                     count(*) FILTER (n_sampled + n_liked >= {AUTHOR_SUPPORT}) AS n_authors_indexed
              FROM (SELECT author_did, sum(n_sampled) AS n_sampled, sum(n_liked) AS n_liked
                    FROM exposures GROUP BY author_did)"""),
)
def e11_stats(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    return authors.author_stats(core.posts, core.likes, t.AUTHOR_SUPPORT)


@query(
    "e12_total_likes",
    with_("SELECT did, count(DISTINCT subject_uri) AS num_total_likes FROM raw_likes GROUP BY did"),
)
def e12(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.total_likes(t.raw_likes(spark, sf))


@query(
    "e13_user_metadata",
    with_("""SELECT did, max(num_embedding_likes) AS num_embedding_likes, max(num_total_likes) AS num_total_likes
             FROM ranking_rows GROUP BY did"""),
)
def e13(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.user_metadata(sc.rows(spark, sf))


@query(
    "e14_distribution",
    with_(f"""SELECT {rnd('avg(n)')} AS mean, {rnd('quantile_cont(n, 0.5)')} AS median, max(n) AS max,
                     {rnd('quantile_cont(n, 0.9)')} AS p90, {rnd('quantile_cont(n, 0.99)')} AS p99
              FROM (SELECT did, count(*) AS n FROM labelled GROUP BY did)"""),
)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    counts = cohorts.likes_per_user(labelled(spark, sf))
    spread = profile.distribution(counts, "like_count")
    return spread.withColumns({c: t.rounded(c) for c in ("mean", "median", "p90", "p99")})


@query(
    "e14_distribution_orders",
    f"""SELECT {rnd('avg(o_totalprice)', 3)} AS mean, {rnd('quantile_cont(o_totalprice, 0.5)', 4)} AS median,
               max(o_totalprice) AS max, {rnd('quantile_cont(o_totalprice, 0.9)', 4)} AS p90,
               {rnd('quantile_cont(o_totalprice, 0.99)', 4)} AS p99 FROM orders""",
)
def e14_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Nearly every value is distinct here, so the positions do the work."""
    spread = profile.distribution(t.table(spark, sf, "orders").select("o_totalprice"), "o_totalprice")
    return spread.withColumns(
        {"mean": t.rounded("mean", 3), **{c: t.rounded(c, 4) for c in ("median", "p90", "p99")}}
    )


def _nearest(q: float) -> str:
    return f"sorted[CAST(floor((n - 1) * {q} + 0.5) AS BIGINT) + 1]"


CAP = 10


@query(
    "e15_history_distribution",
    with_(
        f"""SELECT stage, n AS n_users, {rnd('m')} AS mean, {rnd('median')} AS median, sorted[1] AS min, sorted[n] AS max,
                   {_nearest(0.25)} AS p25, {_nearest(0.75)} AS p75, {_nearest(0.9)} AS p90, {_nearest(0.95)} AS p95,
                   {_nearest(0.99)} AS p99, capped AS n_users_capped, CAST(dropped AS BIGINT) AS n_likes_dropped
            FROM (SELECT stage, count(*) AS n, avg(x) AS m, quantile_cont(x, 0.5) AS median, list_sort(list(x)) AS sorted,
                         count(*) FILTER (x > {CAP}) AS capped, sum(greatest(x - {CAP}, 0)) AS dropped
                  FROM (SELECT 'before' AS stage, x FROM lengths
                        UNION ALL SELECT 'after', least(x, {CAP}) FROM lengths) GROUP BY stage)""",
        lengths="SELECT did, arg_max(raw_prior_count, like_hour_bucket) AS x FROM history GROUP BY did",
    ),
)
def e15(spark: SparkSession, sf: str) -> DataFrame:
    spread = history_ops.history_distribution(t.history(spark, sf), CAP)
    return spread.withColumns({"mean": t.rounded("mean"), "median": t.rounded("median")})


@query(
    "e16_history_summary",
    with_(f"""SELECT count(*) AS n_rows, count(*) FILTER (n_prior > 0) AS n_with_history,
                     count(*) FILTER (n_prior = 0) AS n_empty_history, {rnd('avg(n_prior)')} AS mean_prior,
                     max(n_prior) AS max_prior, min(n_prior) FILTER (n_prior > 0) AS min_prior FROM history"""),
)
def e16(spark: SparkSession, sf: str) -> DataFrame:
    summary = history_ops.history_summary(t.history(spark, sf))
    return summary.withColumn("mean_prior", t.rounded("mean_prior"))


PER_USER = f"""
    SELECT did, count(*) AS num_ranking_rows, CAST(sum(positive_count) AS BIGINT) AS num_positive,
           avg(candidate_count) AS mean_candidate_count, max(num_embedding_likes) AS num_embedding_likes,
           max(num_total_likes) AS num_total_likes, {', '.join(f'avg({m}) AS {m}' for m in METRICS)}
    FROM ranking_rows GROUP BY did"""


@query(
    "e17_per_user_ranking",
    with_(
        f"""SELECT did, num_ranking_rows, num_positive, {rnd('mean_candidate_count')} AS mean_candidate_count,
                   num_embedding_likes, num_total_likes, {', '.join(f'{rnd(m)} AS {m}' for m in METRICS)} FROM per_user""",
        per_user=PER_USER,
    ),
)
def e17(spark: SparkSession, sf: str) -> DataFrame:
    per_user = inequality.per_user_ranking(sc.rows(spark, sf), METRICS)
    return per_user.withColumns({c: t.rounded(c) for c in ("mean_candidate_count", *METRICS)})


LONG = " UNION ALL ".join(f"SELECT did, '{m}' AS metric, {m} AS value FROM per_user" for m in METRICS)
PLACED = """
    SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value, did) AS i,
           count(*) OVER (PARTITION BY metric) AS n, sum(value) OVER (PARTITION BY metric) AS total,
           sum(value) OVER (PARTITION BY metric ORDER BY value, did ROWS UNBOUNDED PRECEDING) AS so_far
    FROM (SELECT * FROM long WHERE value IS NOT NULL)"""
GINI = "CASE WHEN sum(value) = 0 THEN 0 ELSE 2 * sum(i * value) / (max(n) * sum(value)) - (max(n) + 1) / max(n) END"


def _per_user_long(spark: SparkSession, sf: str) -> DataFrame:
    return inequality.long_metrics(inequality.per_user_ranking(sc.rows(spark, sf), METRICS), METRICS)


@query(
    "e18_inequality_summary",
    with_(
        f"""SELECT metric, {rnd(GINI)} AS gini, count(*) AS n_users, {rnd('avg(value)')} AS mean,
                   {rnd('stddev_pop(value)')} AS std, {rnd('quantile_cont(value, 0.5)')} AS median,
                   {rnd('min(value)')} AS min, {rnd('max(value)')} AS max FROM placed GROUP BY metric""",
        per_user=PER_USER, long=LONG, placed=PLACED,
    ),
)
def e18(spark: SparkSession, sf: str) -> DataFrame:
    summary = inequality.inequality_summary(_per_user_long(spark, sf))
    return summary.withColumns({c: t.rounded(c) for c in ("gini", "mean", "std", "median", "min", "max")})


@query(
    "e19_gini",
    f"""SELECT o_orderstatus AS metric, {rnd(GINI)} AS gini
        FROM (SELECT o_orderstatus, o_totalprice AS value, count(*) OVER (PARTITION BY o_orderstatus) AS n,
                     row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS i FROM orders)
        GROUP BY o_orderstatus""",
)
def e19(spark: SparkSession, sf: str) -> DataFrame:
    """Gini of the order totals per order status."""
    orders = t.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").alias("value")
    )
    return inequality.gini(orders).withColumn("gini", t.rounded("gini"))


@query(
    "e20_lorenz",
    with_(
        f"""SELECT metric, i AS position, {rnd('i / n')} AS population_share,
                   {rnd('so_far / CASE WHEN total > 0 THEN total ELSE 1 END')} AS value_share FROM placed
            UNION ALL SELECT DISTINCT metric, 0, 0.0, 0.0 FROM placed""",
        per_user=PER_USER, long=LONG, placed=PLACED,
    ),
)
def e20(spark: SparkSession, sf: str) -> DataFrame:
    curve = inequality.lorenz(_per_user_long(spark, sf))
    return curve.withColumns({c: t.rounded(c) for c in ("population_share", "value_share")})


def _class_sql(by: str) -> str:
    tp, said, p = "count(*) FILTER (y_true = 1 AND y_pred_proba > 0.5)", "count(*) FILTER (y_pred_proba > 0.5)", "count(*) FILTER (y_true = 1)"
    return f"""{rnd(f'coalesce({tp} / nullif({said}, 0), 0)')} AS "precision", {rnd(f'coalesce({tp} / nullif({p}, 0), 0)')} AS recall,
               {rnd(f'coalesce(2 * {tp} / nullif({said} + {p}, 0), 0)')} AS f1"""


CLASS = evaluation.CLASS_METRICS


@query("e21_classification", with_(f"SELECT {_class_sql('')} FROM predictions"))
def e21(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluation.classification_metrics(predictions(spark, sf))
    return metrics.withColumns({c: t.rounded(c) for c in CLASS})


AUC_RANKS = """
    SELECT {keys} y_true, y_pred_proba,
           rank() OVER (PARTITION BY {part} ORDER BY y_pred_proba)
             + (count(*) OVER (PARTITION BY {part}, y_pred_proba) - 1) / 2 AS r FROM {source}"""
AUC = """(sum(r) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2)
         / nullif(count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0), 0)"""


@query(
    "e22_per_user_classification",
    with_(
        f"""SELECT did, count(*) AS num_samples, count(*) FILTER (y_true = 1) AS num_positive,
                   count(*) FILTER (y_true = 0) AS num_negative,
                   {rnd('count(*) FILTER ((y_true = 1) = (y_pred_proba > 0.5)) / count(*)')} AS accuracy,
                   {_class_sql('did')}, {rnd(AUC)} AS auc_roc FROM r GROUP BY did""",
        r=AUC_RANKS.format(keys="did,", part="did", source="predictions"),
    ),
)
def e22(spark: SparkSession, sf: str) -> DataFrame:
    per_user = evaluation.per_user_classification(predictions(spark, sf))
    return per_user.withColumns({c: t.rounded(c) for c in ("accuracy", *CLASS, "auc_roc")})


@query(
    "e23_auc_with_ties",
    with_(
        f"SELECT split, {rnd(AUC)} AS auc_roc FROM r GROUP BY split",
        r=AUC_RANKS.format(keys="split,", part="split", source="s"),
        s="SELECT split, label AS y_true, round(score, 9) AS y_pred_proba FROM scores",
    ),
)
def e23(spark: SparkSession, sf: str) -> DataFrame:
    """Popularity scores are few and tie often."""
    pairs = sc.scored(spark, sf).withColumn("score", F.round("score", 9))
    return ranking.threshold_metrics(pairs, ["split"]).select("split", t.rounded("auc_roc").alias("auc_roc"))


AP_SQL = """
    SELECT split, pos, sum(pos) OVER w / sum(n) OVER w AS prec, sum(pos) OVER (PARTITION BY split) AS p
    FROM (SELECT split, round(score, 9) AS score, sum(label) AS pos, count(*) AS n FROM scores GROUP BY ALL)
    WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""


@query(
    "e24_average_precision",
    with_(f"SELECT split, {rnd('sum(pos * prec) / max(p)')} AS average_precision FROM a GROUP BY split", a=AP_SQL),
)
def e24(spark: SparkSession, sf: str) -> DataFrame:
    pairs = sc.scored(spark, sf).withColumn("score", F.round("score", 9))
    return ranking.threshold_metrics(pairs, ["split"]).select(
        "split", t.rounded("average_precision").alias("average_precision")
    )


BINNED_ROWS = f"""
    SELECT {BIN_SQL} AS bin, count(*) AS n_ranking_rows, count(DISTINCT did) AS n_users,
           CAST(sum(positive_count) AS BIGINT) AS n_positive, avg(num_embedding_likes) AS mean_embedding_likes,
           avg(candidate_count) AS mean_candidate_count, min(num_embedding_likes) AS bin_start,
           {', '.join(f'avg({m}) AS {m}, count({m}) AS {m}_n' for m in METRICS)}
    FROM ranking_rows GROUP BY ALL"""


@query(
    "e25_binned_ranking",
    with_(
        f"""SELECT bin, n_ranking_rows, n_users, n_positive, {rnd('mean_embedding_likes')} AS mean_embedding_likes,
                   {rnd('mean_candidate_count')} AS mean_candidate_count,
                   {', '.join(f'{rnd(m)} AS {m}, {m}_n' for m in METRICS)} FROM binned_rows""",
        binned_rows=BINNED_ROWS,
    ),
)
def e25(spark: SparkSession, sf: str) -> DataFrame:
    binned = evaluation.binned_ranking(sc.rows(spark, sf), METRICS).drop("bin_no")
    return binned.withColumns({c: t.rounded(c) for c in ("mean_embedding_likes", "mean_candidate_count", *METRICS)})


BINNED_PREDICTIONS = f"""
    SELECT {BIN_SQL} AS bin, min(num_embedding_likes) AS bin_start, count(*) AS n_predictions,
           count(DISTINCT did) AS n_users, count(*) FILTER (y_true = 1) AS n_positive,
           avg(num_embedding_likes) AS mean_embedding_likes, {_class_sql('bin')}
    FROM predictions GROUP BY ALL"""


@query(
    "e26_binned_predictions",
    with_(
        f"""SELECT bin, n_predictions, n_users, n_positive, {rnd('mean_embedding_likes')} AS mean_embedding_likes,
                   "precision", recall, f1 FROM binned_predictions""",
        binned_predictions=BINNED_PREDICTIONS,
    ),
)
def e26(spark: SparkSession, sf: str) -> DataFrame:
    binned = evaluation.binned_predictions(predictions(spark, sf)).drop("bin_no")
    return binned.withColumns({c: t.rounded(c) for c in ("mean_embedding_likes", *CLASS)})


def _curve_sql(source: str, metrics: list[str], threshold: bool) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, bin, bin_start, round({m}, 6) AS value FROM {source} WHERE {m} IS NOT NULL" for m in metrics
    )
    reached = (
        ", arg_min(bin, bin_start) FILTER (value >= best * 0.9) AS cold_start_threshold_bin" if threshold else ""
    )
    return f"""SELECT metric, arg_min(bin, bin_start) FILTER (value = best) AS max_bin,
                      {rnd('arg_max(value, bin_start) - arg_min(value, bin_start)', 5)} AS improvement_first_to_last{reached}
               FROM (SELECT *, max(value) OVER (PARTITION BY metric) AS best FROM ({long}))
               GROUP BY metric HAVING count(*) >= 2"""


def _stats_sql(source: str) -> str:
    return f"""SELECT count(*) AS total_rows, count(DISTINCT did) AS total_users, {rnd('avg(num_embedding_likes)')} AS mean_history,
                      {rnd('quantile_cont(num_embedding_likes, 0.5)')} AS median_history,
                      {rnd('stddev_samp(num_embedding_likes)')} AS std_history,
                      min(num_embedding_likes) AS min_history, max(num_embedding_likes) AS max_history FROM {source}"""


def stats_text(rows: DataFrame) -> DataFrame:
    stats = evaluation.history_stats(rows)
    return stats.withColumns({c: t.rounded(c) for c in ("mean_history", "median_history", "std_history")})


@query("e27_history_stats_ranking", with_(_stats_sql("ranking_rows")))
def e27_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stats_text(sc.rows(spark, sf))


@query("e27_history_stats_predictions", with_(_stats_sql("predictions")))
def e27_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return stats_text(predictions(spark, sf))


@query(
    "e27_curve_summary_ranking",
    with_(_curve_sql("binned_rows", METRICS, False), binned_rows=BINNED_ROWS),
)
def e27_curve_rows(spark: SparkSession, sf: str) -> DataFrame:
    binned = evaluation.binned_ranking(sc.rows(spark, sf), METRICS)
    rounded = binned.withColumns({c: F.round(c, 6) for c in METRICS})
    summary = evaluation.curve_summary(rounded, METRICS, with_threshold=False)
    return summary.withColumn("improvement_first_to_last", t.rounded("improvement_first_to_last", 5))


@query(
    "e27_curve_summary_predictions",
    with_(_curve_sql("binned_predictions", ['"precision"', "recall", "f1"], True).replace("'\"precision\"'", "'precision'"),
          binned_predictions=BINNED_PREDICTIONS),
)
def e27_curve_predictions(spark: SparkSession, sf: str) -> DataFrame:
    binned = evaluation.binned_predictions(predictions(spark, sf)).withColumns({c: F.round(c, 6) for c in CLASS})
    summary = evaluation.curve_summary(binned, CLASS, with_threshold=True)
    return summary.withColumn("improvement_first_to_last", t.rounded("improvement_first_to_last", 5))


@query(
    "e28_prediction_health",
    with_(
        f"""SELECT count(*) AS n_predictions, count(*) FILTER (y_true = 1) AS n_positive,
                   count(*) FILTER (y_true = 0) AS n_negative, count(*) FILTER (num_embedding_likes = 0) AS n_zero_history,
                   count(*) FILTER (num_embedding_likes = 0 AND y_true = 1) AS n_zero_history_positive,
                   count(*) FILTER (num_embedding_likes = 0 AND y_true = 0) AS n_zero_history_negative,
                   count(DISTINCT did) AS n_users,
                   (SELECT count(*) FROM (SELECT {BIN_SQL} AS bin, count(*) AS n FROM predictions GROUP BY ALL)
                    WHERE n % 2 <> 0) AS n_odd_bins,
                   (SELECT min(s) FROM spans) AS min_history_lengths,
                   (SELECT {rnd('quantile_cont(s, 0.5)')} FROM spans) AS median_history_lengths,
                   (SELECT max(s) FROM spans) AS max_history_lengths
            FROM predictions""",
        spans="SELECT did, count(DISTINCT num_embedding_likes) AS s FROM predictions GROUP BY did",
    ),
)
def e28(spark: SparkSession, sf: str) -> DataFrame:
    health = evaluation.prediction_health(predictions(spark, sf))
    return health.withColumn("median_history_lengths", t.rounded("median_history_lengths"))


@query(
    "e29_popularity_log_stats",
    with_(f"""SELECT {rnd('avg(x)')} AS log_mean, {rnd('stddev_pop(x)')} AS log_std, count(*) AS n_counts FROM (
                SELECT ln(1 + prior_cumulative_likes) AS x FROM history_entries
                UNION ALL SELECT ln(1 + prior_cumulative_likes) FROM likes_core
                UNION ALL SELECT ln(1 + prior_cumulative_likes) FROM posts_core WHERE in_random_sample)"""),
)
def e29(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    stats = evaluation.popularity_log_stats(
        t.history(spark, sf), core.likes, cand.sampled_posts(core.posts)
    )
    return stats.withColumns({"log_mean": t.rounded("log_mean"), "log_std": t.rounded("log_std")})


@query(
    "e32_embedding_check",
    with_(f"""SELECT true AS has_embeddings, count(*) AS n_rows, {rnd('avg(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END)')} AS null_rate,
                     min(len(embedding)) AS min_length, max(len(embedding)) AS max_length FROM post_vectors"""),
)
def e32(spark: SparkSession, sf: str) -> DataFrame:
    check = coverage.embedding_check(t.raw_posts(spark, sf, with_vectors=True), "embedding")
    return check.withColumns({"null_rate": t.rounded("null_rate")})


def _profile_sql(table: str, columns: list[tuple[str, str]], source: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{dtype}' AS dtype,
                   count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_unique,
                   count(*) - count({c}) AS n_null FROM {source or table}"""
        for c, dtype in columns
    )


@query(
    "e33_column_profile",
    _profile_sql(
        "",
        [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
         ("quality", "int"), ("toxic", "int")],
        "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))",
    ),
)
def e33(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id", "left")
    return profile.column_profile(docs)


@query(
    "e33_top_values",
    """SELECT source || '/' || lang AS value, count(*) AS count FROM documents GROUP BY ALL
       ORDER BY count DESC, value LIMIT 20""",
)
def e33_top(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("place"))
    return profile.top_values(docs, "place")


@query(
    "e34_posts_stats",
    with_(f"""SELECT count(*) AS n_posts_core, count(DISTINCT at_uri) AS n_posts_core_unique,
                     count(DISTINCT at_uri) FILTER (is_liked) AS n_liked_posts,
                     count(DISTINCT at_uri) FILTER (is_liked AND NOT in_random_sample) AS n_liked_only,
                     count(DISTINCT at_uri) FILTER (is_liked AND in_random_sample) AS n_liked_in_random_sample,
                     count(*) FILTER (in_random_sample) AS n_random_sample,
                     count(DISTINCT at_uri) FILTER (in_random_sample) AS n_random_sample_unique_posts,
                     count(DISTINCT negative_hour_bucket) FILTER (in_random_sample) AS n_random_sample_buckets,
                     {rnd('''100.0 * count(DISTINCT at_uri) FILTER (is_liked)
                            / (SELECT count(DISTINCT subject_uri) FROM sampled_likes)''')} AS liked_post_match_rate
              FROM sampled_posts"""),
)
def e34(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    stats = posts_ops.posts_stats(core.sampled_posts, core.sampled_likes)
    return stats.withColumn("liked_post_match_rate", t.rounded("liked_post_match_rate"))


STEPS = [
    ("initial scan", "raw_likes", "did"),
    ("min likes", "(SELECT * FROM raw_likes WHERE did IN (SELECT did FROM eligible))", "did"),
    ("user sample and window", "labelled", "did"),
    ("per-user cap", "sampled_likes", "did"),
    ("matching post", "joined_likes", "did"),
    ("min likes again", "verified_likes", "did"),
    ("final likes", "likes_core", "did"),
]
POST_STEPS = [
    ("time window", "window_posts", "at_uri"),
    ("combined candidates", "sampled_posts", "at_uri"),
    ("valid embedding", "posts_core", "at_uri"),
]


def _attrition_sql(steps: list[tuple[str, str, str]]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS step, '{name}' AS name, count(DISTINCT {key}) AS n_keys, count(*) AS n_rows FROM {source}"
        for i, (name, source, key) in enumerate(steps, 1)
    )
    return f"""SELECT step, name, n_keys, n_rows, {rnd('100.0 * n_keys / first_value(n_keys) OVER (ORDER BY step)')} AS keys_kept_pct,
                      {rnd('100.0 * n_rows / first_value(n_rows) OVER (ORDER BY step)')} AS rows_kept_pct FROM ({parts})"""


def _kept(report: DataFrame) -> DataFrame:
    return report.withColumns({c: t.rounded(c) for c in ("keys_kept_pct", "rows_kept_pct")})


@query("e35_attrition_likes", with_(_attrition_sql(STEPS)))
def e35_likes(spark: SparkSession, sf: str) -> DataFrame:
    """Three tables, each read once: raw, sampled and final likes."""
    core, run = t.core(spark, sf), t.settings(spark, sf)
    bound = cohorts.cohort_size_bound(run.max_trainval, run.max_unseen)
    raw = likes_ops.likes_of_cohorts(t.raw_likes(spark, sf), core.cohorts, bound, "left")
    posts = core.posts.select(F.col(N.POST).alias(N.ITEM), F.lit(True).alias("_there")).distinct()
    matched = core.sampled_likes.join(posts, N.ITEM, "left")
    rows = (
        profile.marked(raw, N.USER, {0: True, 2: likes_ops.in_cohort_window(run.windows)})
        .unionByName(profile.marked(matched, N.USER, {3: True, 4: F.col("_there")}))
        .unionByName(profile.marked(core.likes, N.USER, {6: True}))
    )
    least = {1: (0, t.MIN_LIKES), 5: (4, t.MIN_LIKES)}
    return _kept(profile.attrition(rows, [name for name, _, _ in STEPS], least))


@query("e35_attrition_posts", with_(_attrition_sql(POST_STEPS)))
def e35_posts(spark: SparkSession, sf: str) -> DataFrame:
    core = t.core(spark, sf)
    tables = [posts_ops.post_window(t.raw_posts(spark, sf), t.WINDOWS), core.sampled_posts, core.posts]
    rows = [profile.marked(df, N.POST, {i: True}) for i, df in enumerate(tables)]
    return _kept(profile.attrition(rows[0].unionByName(rows[1]).unionByName(rows[2]), [name for name, _, _ in POST_STEPS]))


HISTOGRAM_SQL = """
    SELECT high > 10 * median AS log_scale,
           CAST(CASE WHEN high > 10 * median THEN least(floor(ln(n) / ln(high + 1) * 49), 48)
                     ELSE least(floor((n - CASE WHEN high > low THEN low ELSE low - 0.5 END)
                                / CASE WHEN high > low THEN high - low ELSE 1.0 END * 50), 49) END AS BIGINT) AS bin,
           count(*) AS n_users
    FROM (SELECT n, min(n) OVER () AS low, max(n) OVER () AS high, quantile_cont(n, 0.5) OVER () AS median FROM {source})
    GROUP BY ALL"""


@query(
    "e36_likes_histogram",
    with_(HISTOGRAM_SQL.format(source="c"), c="SELECT CAST(like_count AS DOUBLE) AS n FROM user_counts"),
)
def e36(spark: SparkSession, sf: str) -> DataFrame:
    counts = cohorts.likes_per_user(t.raw_likes(spark, sf))
    return profile.likes_histogram(counts).withColumn("bin", F.col("bin").cast("long"))


@query(
    "e36_log_histogram",
    with_(HISTOGRAM_SQL.format(source="c"), c="SELECT CAST(n_chars AS DOUBLE) AS n FROM documents WHERE n_chars > 0"),
)
def e36_log(spark: SparkSession, sf: str) -> DataFrame:
    """Document lengths are skewed enough for logarithmic bins."""
    lengths = t.table(spark, sf, "documents").select("n_chars").where("n_chars > 0")
    return profile.likes_histogram(lengths, "n_chars").withColumn("bin", F.col("bin").cast("long"))


@query(
    "e36_share_above_cap",
    with_(f"""SELECT count(*) FILTER (like_count > {t.MAX_LIKES}) AS n_above_cap,
                     {rnd(f'100.0 * count(*) FILTER (like_count > {t.MAX_LIKES}) / count(*)')} AS pct_above_cap
              FROM user_counts"""),
)
def e36_share(spark: SparkSession, sf: str) -> DataFrame:
    share = profile.share_above_cap(cohorts.likes_per_user(t.raw_likes(spark, sf)), t.MAX_LIKES)
    return share.withColumn("pct_above_cap", t.rounded("pct_above_cap"))
