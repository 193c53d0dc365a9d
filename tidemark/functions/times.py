"""Timestamps, hour buckets and ages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted timestamp formats, first match wins, no zone means UTC.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssxx",
    "yyyy-MM-dd'T'HH:mm:ssxxx",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
]


def parse_timestamp(col: Column | str, strict: bool = True) -> Column:
    """Parse a text time in any accepted format; strict raises on anything else."""
    text = F.col(col) if isinstance(col, str) else col
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS])
    if not strict:
        return parsed
    message = F.concat(F.lit("no accepted time format fits: "), text)
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("timestamp"))


def hour_bucket(col: Column | str) -> Column:
    """Start of the hour of a timestamp."""
    return F.date_trunc("hour", col)


def hour_bucket_text(col: Column | str) -> Column:
    """Start of the hour of a text time; whatever follows the hour is dropped."""
    text = F.col(col) if isinstance(col, str) else col
    return F.concat(F.substring(text, 1, 13), F.lit(":00:00"))


def like_age_hours(bucket: Column | str, ts: Column | str) -> Column:
    """Whole seconds from ``ts`` to ``bucket``, in hours, single precision."""
    return (age_seconds(bucket, ts) / F.lit(3600.0)).cast("float")


def age_seconds(bucket: Column | str, ts: Column | str) -> Column:
    return F.floor((F.unix_micros(bucket) - F.unix_micros(ts)) / F.lit(1_000_000.0))


def check_boundaries(boundaries: Sequence[float]) -> list[float]:
    values = [float(b) for b in boundaries]
    if not values:
        raise ValueError("at least one boundary is needed")
    if values[0] <= 0:
        raise ValueError("the first boundary must lie above 0")
    if any(b <= a for a, b in zip(values, values[1:])):
        raise ValueError("each boundary must lie above the one before")
    return values


def time_delta_bucket(delta: Column | str, boundaries: Sequence[float]) -> Column:
    """0 when not positive, else 1 + the number of boundaries below the delta."""
    delta = (F.col(delta) if isinstance(delta, str) else delta).cast("double")
    bucket = F.lit(1)
    for boundary in check_boundaries(boundaries):
        bucket = bucket + (delta > F.lit(boundary)).cast("int")
    return F.when(delta <= 0, F.lit(0)).otherwise(bucket)


def time_literal(value: str) -> Column:
    return F.lit(value).cast("timestamp")
