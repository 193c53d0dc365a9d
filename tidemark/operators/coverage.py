"""Data coverage of sources by hour, day and file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import hour_bucket
from tidemark.names import TS


def hourly_counts(df: DataFrame, column: str = TS) -> DataFrame:
    """Rows per hour; an empty table when the column is missing."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "hour timestamp, count bigint")
    return df.groupBy(hour_bucket(F.col(column).cast("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def sources_hourly(sources: dict[str, DataFrame], column: str = TS) -> DataFrame:
    """``(source, hour, count)`` of several sources."""
    parts = [hourly_counts(df, column).withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def daily_comparison(hourly: DataFrame, sources: list[str]) -> DataFrame:
    """One row per date of any source, one count column per source, 0 when missing."""
    return (
        hourly.groupBy(F.to_date("hour").alias("date"))
        .pivot("source", sources)
        .agg(F.sum("count"))
        .na.fill(0, sources)
    )


def coverage_summary(hourly: DataFrame) -> DataFrame:
    """Totals and range of each source."""
    return hourly.groupBy("source").agg(
        F.sum("count").alias("total_records"),
        F.min("hour").alias("min_hour"),
        F.max("hour").alias("max_hour"),
        F.count(F.lit(1)).alias("hours_with_data"),
        (F.sum("count") / F.count(F.lit(1))).alias("avg_per_hour"),
    )


def file_density(stamps: DataFrame, column: str = "stamp") -> DataFrame:
    """Files per day: totals, gaps, mean to one decimal, smallest and largest day."""
    daily = stamps.groupBy(F.to_date(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    days = F.count(F.lit(1))
    span = F.datediff(F.max("d"), F.min("d")) + 1
    return daily.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"),
        days.alias("days_with_data"),
        F.coalesce(span, F.lit(0)).alias("expected_days"),
        F.coalesce(span - days, F.lit(0)).alias("missing_days"),
        F.coalesce(F.round(F.avg("n"), 1), F.lit(0.0)).alias("mean_files_per_day"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_files_per_day"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_files_per_day"),
    )


def embedding_check(df: DataFrame, column: str = "embeddings") -> DataFrame:
    """Whether the column is there, how often it is null and how long its lists are."""
    spark: SparkSession = df.sparkSession
    if column not in df.columns:
        return spark.range(1).select(
            F.lit(False).alias("has_embeddings"),
            F.lit(0).cast("long").alias("n_rows"),
            F.lit(None).cast("double").alias("null_rate"),
            F.lit(None).cast("int").alias("min_length"),
            F.lit(None).cast("int").alias("max_length"),
        )
    # size(null) is -1 under the legacy setting, so nulls are masked.
    length = F.when(F.col(column).isNotNull(), F.size(column))
    return df.agg(
        F.lit(True).alias("has_embeddings"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col(column).isNull().cast("int")).alias("null_rate"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
    )


def compare_sources(sources: dict[str, DataFrame], column: str = TS, vectors: str = "embeddings") -> DataFrame:
    """Coverage summary and embedding check of several sources, one row each."""
    summary = coverage_summary(sources_hourly(sources, column))
    checks = None
    for name, df in sources.items():
        check = embedding_check(df, vectors).withColumn("source", F.lit(name))
        checks = check if checks is None else checks.unionByName(check)
    return checks.join(summary, "source", "left")
