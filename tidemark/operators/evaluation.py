"""Cold-start curves and classification reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.bins import bin_index, bin_label, decision
from tidemark.names import BIN_EDGES, USER
from tidemark.operators.ranking import threshold_metrics
from tidemark.plans.durable import cut
from tidemark.plans.ordered import exact_quantiles
from tidemark.plans.scalars import row_of

HISTORY = "num_embedding_likes"
CLASS_METRICS = ["precision", "recall", "f1"]


def _ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` with 0 for an empty whole."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _confusion() -> list[Column]:
    says, truth = decision("y_pred_proba") == 1, F.col("y_true") == 1
    return [
        F.count(F.lit(1)).alias("_n"),
        F.count_if(truth).alias("_p"),
        F.count_if(says).alias("_said"),
        F.count_if(says & truth).alias("_tp"),
        F.count_if(says == truth).alias("_right"),
    ]


def _class_metrics() -> dict[str, Column]:
    tp, said, p = F.col("_tp"), F.col("_said"), F.col("_p")
    return {"precision": _ratio(tp, said), "recall": _ratio(tp, p), "f1": _ratio(tp * 2.0, said + p)}


def classification_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 at one half; an empty denominator gives 0."""
    counted = predictions.groupBy(*by).agg(*_confusion())
    return counted.select(*by, *[m.alias(n) for n, m in _class_metrics().items()])


def per_user_classification(predictions: DataFrame) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and AUC of each user; AUC null for one class."""
    counted = predictions.groupBy(USER).agg(*_confusion())
    auc = threshold_metrics(predictions, [USER], "y_pred_proba", "y_true").select(USER, "auc_roc")
    return counted.join(auc, USER).select(
        USER,
        F.col("_n").alias("num_samples"),
        F.col("_p").alias("num_positive"),
        (F.col("_n") - F.col("_p")).alias("num_negative"),
        (F.col("_right") / F.col("_n")).alias("accuracy"),
        *[m.alias(n) for n, m in _class_metrics().items()],
        "auc_roc",
    )


def user_metadata(rows: DataFrame) -> DataFrame:
    """Largest history and like counters per user, 0 when unknown."""
    return rows.groupBy(USER).agg(
        F.coalesce(F.max(HISTORY), F.lit(0)).alias(HISTORY),
        F.coalesce(F.max("num_total_likes"), F.lit(0)).alias("num_total_likes"),
    )


def total_likes(likes: DataFrame) -> DataFrame:
    """Distinct liked posts per user."""
    return (
        likes.select(USER, "subject_uri").distinct().groupBy(USER).agg(F.count(F.lit(1)).alias("num_total_likes"))
    )


def with_bin(df: DataFrame, edges: Sequence[int] = BIN_EDGES) -> DataFrame:
    """Add the history bin; an unknown history counts as none."""
    return df.withColumn("bin_no", bin_index(F.coalesce(F.col(HISTORY), F.lit(0)), edges))


def _users_per_bin(binned: DataFrame) -> DataFrame:
    """Distinct users per bin, counted over distinct (bin, user) pairs."""
    return binned.select("bin_no", USER).distinct().groupBy("bin_no").agg(F.count(USER).alias("n_users"))


def binned_ranking(rows: DataFrame, metrics: Sequence[str], edges: Sequence[int] = BIN_EDGES) -> DataFrame:
    """Ranking metrics per cold-start bin; empty bins have no row."""
    binned = with_bin(rows, edges)
    stats = binned.groupBy("bin_no").agg(
        F.count(F.lit(1)).alias("n_ranking_rows"),
        F.sum("positive_count").alias("n_positive"),
        F.avg(F.coalesce(F.col(HISTORY), F.lit(0))).alias("mean_embedding_likes"),
        F.avg("candidate_count").alias("mean_candidate_count"),
        *[F.avg(m).alias(m) for m in metrics],
        *[F.count(m).alias(f"{m}_n") for m in metrics],
    )
    joined = stats.join(_users_per_bin(binned), "bin_no")
    return joined.withColumn("bin", bin_label("bin_no", edges))


def binned_predictions(predictions: DataFrame, edges: Sequence[int] = BIN_EDGES) -> DataFrame:
    """Pooled classification metrics per cold-start bin."""
    binned = with_bin(predictions, edges)
    stats = binned.groupBy("bin_no").agg(*_confusion(), F.avg(HISTORY).alias("mean_embedding_likes"))
    return (
        stats.join(_users_per_bin(binned), "bin_no")
        .withColumn("bin", bin_label("bin_no", edges))
        .select(
            "bin_no",
            "bin",
            F.col("_n").alias("n_predictions"),
            "n_users",
            F.col("_p").alias("n_positive"),
            "mean_embedding_likes",
            *[m.alias(n) for n, m in _class_metrics().items()],
        )
    )


def history_totals(rows: DataFrame) -> DataFrame:
    """Rows, users and mean history length, one row; users are counted in one grouping with the rest."""
    length = F.coalesce(F.col(HISTORY), F.lit(0)).cast("long")
    per_user = rows.groupBy(USER).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("sum"))
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("total_users"),
        (F.sum("sum") / F.sum("n")).alias("mean_history"),
    )


def history_stats(rows: DataFrame) -> DataFrame:
    """Totals and spread of the history length over all rows, one row."""
    length = F.coalesce(F.col(HISTORY), F.lit(0)).cast("long")
    lengths = rows.select(USER, length.alias(HISTORY))
    users = lengths.select(USER).distinct().agg(F.count(USER).alias("n"))
    median = exact_quantiles(lengths, [], HISTORY, {"median": 0.5})
    return lengths.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.avg(HISTORY).alias("mean_history"),
        F.stddev_samp(HISTORY).alias("std_history"),
        F.min(HISTORY).alias("min_history"),
        F.max(HISTORY).alias("max_history"),
    ).select(
        "*",
        users.scalar().alias("total_users"),
        median.scalar().alias("median_history"),
    )


def curve_summary(binned: DataFrame, metrics: Sequence[str], with_threshold: bool) -> DataFrame:
    """Per metric: best bin, last minus first, and the first bin at 90 % of the best.

    Works on the bin table (a row per bin).  Metrics with fewer than two bins are
    left out; the threshold is only asked for on predictions.
    """
    long = binned.select("bin_no", "bin", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["bin_no", "bin"], list(metrics), "metric", "value"
    ).where(F.col("value").isNotNull())
    best = F.max("value").over(Window.partitionBy("metric"))
    marked = long.withColumn("_best", best)
    aggs = [
        F.min_by("bin", F.when(F.col("value") == F.col("_best"), F.col("bin_no"))).alias("max_bin"),
        (F.max_by("value", "bin_no") - F.min_by("value", "bin_no")).alias("improvement_first_to_last"),
        F.count(F.lit(1)).alias("_bins"),
    ]
    if with_threshold:
        reached = F.col("value") >= F.col("_best") * 0.9
        aggs.append(F.min_by("bin", F.when(reached, F.col("bin_no"))).alias("cold_start_threshold_bin"))
    return marked.groupBy("metric").agg(*aggs).where(F.col("_bins") >= 2).drop("_bins")


def prediction_health(predictions: DataFrame, edges: Sequence[int] = BIN_EDGES) -> DataFrame:
    """Totals, zero-history rows, bins with an odd count, and history lengths per user."""
    truth = F.col("y_true") == 1
    zero = F.coalesce(F.col(HISTORY), F.lit(0)) == 0
    binned = with_bin(predictions, edges)
    odd = (
        binned.groupBy("bin_no").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") % 2 != 0).alias("n"))
    )
    spans = cut(predictions.select(USER, HISTORY).distinct().groupBy(USER).agg(F.count(HISTORY).alias("spans")))
    median = exact_quantiles(spans, [], "spans", {"median": 0.5})
    per_user = spans.agg(
        F.count(F.lit(1)).alias("n_users"), F.min("spans").alias("low"), F.max("spans").alias("high")
    )
    return predictions.agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count_if(truth).alias("n_positive"),
        F.count_if(~truth).alias("n_negative"),
        F.count_if(zero).alias("n_zero_history"),
        F.count_if(zero & truth).alias("n_zero_history_positive"),
        F.count_if(zero & ~truth).alias("n_zero_history_negative"),
    ).withColumn("_user", row_of(per_user)).select(
        *["n_predictions", "n_positive", "n_negative"],
        *["n_zero_history", "n_zero_history_positive", "n_zero_history_negative"],
        F.col("_user.n_users").alias("n_users"),
        odd.scalar().alias("n_odd_bins"),
        F.col("_user.low").alias("min_history_lengths"),
        median.scalar().alias("median_history_lengths"),
        F.col("_user.high").alias("max_history_lengths"),
    )


def popularity_log_stats(history: DataFrame, likes: DataFrame, negatives: DataFrame) -> DataFrame:
    """Mean and population deviation of ``log(1 + count)`` over all three sources.

    No rows give (0, 1); a deviation below 1e-6 becomes 1.
    """
    counts = (
        history.select(F.explode(F.transform("prior_cumulative_likes", lambda c: c.cast("double"))).alias("c"))
        .unionByName(likes.select(F.coalesce(F.col("prior_cumulative_likes"), F.lit(0)).cast("double").alias("c")))
        .unionByName(negatives.select(F.coalesce(F.col("prior_cumulative_likes"), F.lit(0)).cast("double").alias("c")))
    )
    logs = counts.select(F.log1p(F.greatest("c", F.lit(0.0))).alias("x"))
    stats = logs.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("x").alias("n_counts"))
    return stats.select(
        F.coalesce("m", F.lit(0.0)).alias("log_mean"),
        F.when(F.col("s") >= 1e-6, F.col("s")).otherwise(F.lit(1.0)).alias("log_std"),
        "n_counts",
    )
