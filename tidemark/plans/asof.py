"""Point-in-time lookup: the last known value at or before a target time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_backward(
    targets: DataFrame,
    curve: DataFrame,
    key: str,
    target_time: str,
    curve_time: str,
    value: str,
    default=0,
    segment: str | None = None,
) -> DataFrame:
    """``(key, target_time, value)`` for every distinct target.

    Targets and curve rows are stacked and one running ``last`` fills the value
    in, so the cost is one shuffle of both sides and no pair is ever formed.  A
    curve row at the very target time counts.

    With hour grain a key has at most one row per hour on each side.  For finer
    times set ``segment`` (a ``date_trunc`` unit, such as ``"day"``): the window
    then works per key and segment and the last value of the earlier segments is
    joined on, so that a hot key is spread over its segments.
    """
    dtype = curve.schema[value].dataType
    stacked = (
        curve.select(F.col(key), F.col(curve_time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
        .unionByName(
            targets.select(F.col(key), F.col(target_time).alias("_t"))
            .distinct()
            .withColumns({"_v": F.lit(None).cast(dtype), "_side": F.lit(1)})
        )
    )
    groups = [key]
    if segment is not None:
        stacked = stacked.withColumn("_segment", F.date_trunc(segment, "_t"))
        groups = [key, "_segment"]
    running = Window.partitionBy(*groups).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = stacked.withColumn("_v", F.last("_v", ignorenulls=True).over(running)).where(F.col("_side") == 1)
    if segment is not None:
        earlier = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            stacked.groupBy(key, "_segment")
            .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
            .select(key, "_segment", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
        )
        filled = filled.join(carry, [key, "_segment"]).withColumn("_v", F.coalesce("_v", "_carry"))
    return filled.select(
        key,
        F.col("_t").alias(target_time),
        _with_default(F.col("_v"), default, dtype).alias(value),
    )


def _with_default(col: Column, default, dtype) -> Column:
    return col if default is None else F.coalesce(col, F.lit(default).cast(dtype))
