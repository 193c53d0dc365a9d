"""Broadcast only what has a proven bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def broadcast_if_bounded(df: DataFrame, max_rows: int | None, row_bytes: int) -> tuple[DataFrame, bool]:
    """Hint a broadcast when ``max_rows * row_bytes`` is known to be small.

    ``max_rows`` is a bound that follows from a parameter (a row cap), never an
    estimate; ``None`` means unknown and leaves the choice to adaptive execution,
    which goes by the measured size.
    """
    if max_rows is not None and max_rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df), True
    return df, False
