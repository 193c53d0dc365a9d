"""How unevenly a metric is spread over users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.names import USER
from tidemark.plans.durable import cut
from tidemark.plans.ordered import quantiles_of, ranged, ranked_counts, running_before


def per_user_ranking(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows, positives, counters and mean metrics of each user; nulls are skipped."""
    return rows.groupBy(USER).agg(
        F.count(F.lit(1)).alias("num_ranking_rows"),
        F.sum("positive_count").alias("num_positive"),
        F.avg("candidate_count").alias("mean_candidate_count"),
        F.max("num_embedding_likes").alias("num_embedding_likes"),
        F.max("num_total_likes").alias("num_total_likes"),
        *[F.avg(m).alias(m) for m in metrics],
    )


def long_metrics(per_user: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``(did, metric, value)`` without nulls."""
    wide = per_user.select(USER, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(USER, list(metrics), "metric", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def gini(values: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Gini coefficient per group; all zeros give 0."""
    return gini_of(ranked_counts(values, keys, value), keys, value)


def gini_of(ranked: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Gini coefficient from counted values.

    A value with ``below`` smaller ones and ``n`` copies fills the positions
    ``below + 1 .. below + n``, whose sum is known.
    """
    copies, below, x = F.col("n").cast("double"), F.col("below").cast("double"), F.col(value)
    weighted = F.sum(x * (copies * below + copies * (copies + 1) / 2))
    total, n = F.sum(x * copies), F.sum(copies)
    return ranked.groupBy(*keys).agg(
        F.when(total == 0, F.lit(0.0)).otherwise(2 * weighted / (n * F.nullif(total, F.lit(0.0))) - (n + 1) / n).alias("gini")
    )


def lorenz(values: DataFrame, value: str = "value", tie: str = USER, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Lorenz curve per group: position, population share and value share, with the origin.

    Positions and sums come from parts of the order, cut on value and user together, so
    that equal values do not pile up in one task.
    """
    keys = list(keys)
    values = ranged(values.select(*keys, value, tie), [*keys, value, tie])
    placed = running_before(values, keys, [value, tie], {"_i": F.lit(1), "_before": F.col(value)}, placed=True)
    totals = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_total"))
    joined = placed.join(totals, keys)
    point = F.col("_i") + 1
    shares = joined.select(
        *keys,
        point.cast("long").alias("position"),
        (point / F.col("_n")).alias("population_share"),
        ((F.col("_before") + F.col(value)) / F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0)).alias("value_share"),
    )
    origin = totals.select(
        *keys,
        F.lit(0).cast("long").alias("position"),
        F.lit(0.0).alias("population_share"),
        F.lit(0.0).alias("value_share"),
    )
    return shares.unionByName(origin)


def inequality_summary(values: DataFrame) -> DataFrame:
    """Per metric: Gini, users, mean, population deviation, median, smallest, largest."""
    values = cut(values)
    stats = values.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    ranked = ranked_counts(values, ["metric"], "value")
    median = quantiles_of(ranked, ["metric"], "value", {"median": 0.5})
    return stats.join(gini_of(ranked), "metric").join(median, "metric")
