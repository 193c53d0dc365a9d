"""One-row tables as columns of another plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_of(df: DataFrame) -> Column:
    """A one-row table as one struct value: a single subquery however many fields are used."""
    return df.select(F.struct(*df.columns)).scalar()
