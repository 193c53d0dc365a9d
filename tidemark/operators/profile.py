"""Column profiles, count distributions and the attrition report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import cut
from tidemark.plans.ordered import quantiles_of, ranked_counts
from tidemark.plans.scalars import row_of

SHORT_TEXT = 64  # a marked digest is longer


def column_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, n_unique, n_null)``; null counts as one value.

    Every column is turned into rows of (column, value) and counted once per value,
    so all columns share one shuffle with map-side counts.  A long text travels as
    its SHA-256 digest, marked so that it cannot meet a short text.
    """

    def token(name: str) -> Column:
        text = F.col(name).cast("string")
        digest = F.concat(F.lit("sha256:"), F.sha2(text, 256))
        return F.when(F.length(text) > SHORT_TEXT, digest).otherwise(text)

    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), token(c).alias("value")) for c, t in df.dtypes
    ]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    per_value = long.groupBy("column", "dtype", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column", "dtype").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Most frequent values; ties by value, null included."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(n)


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, largest, 90th and 99th percentile with linear interpolation."""
    ranked = ranked_counts(df, [], value)
    spread = quantiles_of(ranked, [], value, {"median": 0.5, "p90": 0.9, "p99": 0.99})
    ends = ranked.agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.max(value).alias("max"))
    return spread.withColumn("_ends", row_of(ends)).select("_ends.mean", "median", "_ends.max", "p90", "p99")


def likes_histogram(counts: DataFrame, value: str = "like_count", bins: int = 50) -> DataFrame:
    """Users per bin of their like count; empty bins have no row.

    Bins are even between the smallest and largest count.  When the largest exceeds
    ten medians they are even in the logarithm, ``bins - 1`` of them from 1 to
    largest + 1.  The last bin includes its upper edge.
    """
    ranked = ranked_counts(counts, [], value)
    median = quantiles_of(ranked, [], value, {"median": 0.5})
    ends = ranked.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    sized = ranked.withColumn("_ends", row_of(ends)).select(
        F.col(value).cast("double").alias("x"), "n", "_ends.low", "_ends.high", median.scalar().alias("median")
    )
    skewed = F.col("high") > F.col("median") * 10
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    start = F.when(F.col("high") > F.col("low"), F.col("low")).otherwise(F.col("low") - 0.5)
    even = F.least(F.floor((F.col("x") - start) / span * bins), F.lit(bins - 1))
    log_share = F.ln("x") / F.ln(F.col("high") + 1)
    log_even = F.least(F.floor(log_share * (bins - 1)), F.lit(bins - 2))
    return (
        sized.select(skewed.alias("log_scale"), F.when(skewed, log_even).otherwise(even).alias("bin"), "n")
        .groupBy("log_scale", "bin")
        .agg(F.sum("n").alias("n_users"))
    )


def share_above_cap(counts: DataFrame, cap: int, value: str = "like_count") -> DataFrame:
    above = F.count_if(F.col(value) > cap)
    return counts.agg(
        above.alias("n_above_cap"),
        (F.lit(100.0) * above / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("pct_above_cap"),
    )


def marked(df: DataFrame, key: str, steps: dict[int, Column | bool]) -> DataFrame:
    """``(key, steps)``: a row each with a bit for every step it survives."""
    mask = F.lit(0)
    for step, survives in steps.items():
        bit = F.lit(1 << step)
        mask = mask.bitwiseOR(bit if survives is True else F.when(survives, bit).otherwise(0))
    return df.select(F.col(key).alias("key"), mask.alias("steps"))


def attrition(rows: DataFrame, names: Sequence[str], least: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """Distinct keys and rows left after each step, with the share kept of the first step.

    ``rows`` come from :func:`marked`, the tables of several steps one below the other.  One
    grouping by key counts every step at once.  ``least`` names steps that keep the keys with
    enough rows in another step: ``{step: (other, rows)}``; they need no mark and no pass.
    """
    counts = [F.count_if(F.col("steps").bitwiseAND(F.lit(1 << i)) != 0).alias(f"n{i}") for i in range(len(names))]
    per_key = rows.groupBy("key").agg(*counts)
    for step, (other, enough) in sorted((least or {}).items()):
        per_key = per_key.withColumn(f"n{step}", F.when(F.col(f"n{other}") >= enough, F.col(f"n{other}")).otherwise(0))
    totals = per_key.agg(
        *[F.count_if(F.col(f"n{i}") > 0).alias(f"keys{i}") for i in range(len(names))],
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"rows{i}") for i in range(len(names))],
    )

    def share(part: str, i: int) -> Column:
        return F.lit(100.0) * F.col(f"{part}{i}") / F.nullif(F.col(f"{part}0"), F.lit(0))

    lines = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(name).alias("name"),
            F.col(f"keys{i}").alias("n_keys"),
            F.col(f"rows{i}").alias("n_rows"),
            share("keys", i).alias("keys_kept_pct"),
            share("rows", i).alias("rows_kept_pct"),
        )
        for i, name in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*lines)))
