"""Top-n per group with a map-side cut, and one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 32


def salt_of(*cols: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    n: int,
    salt: Column | None = None,
    rank_name: str | None = None,
) -> DataFrame:
    """First ``n`` rows of each group; ``order`` must be total inside a group.

    ``row_number() <= n`` keeps at most ``n`` rows per group in each map task
    before the shuffle.  With few or hot groups that still sends ``tasks * n``
    rows to one reducer; a ``salt`` spreads them over more reducers, so that the
    last step sees at most ``salts * n`` rows per group.
    """
    rank = rank_name or "_rank"
    if salt is not None:
        # One struct column: rows already hashed on the keys alone must move again.
        salted = Window.partitionBy("_salted").orderBy(*order)
        df = (
            df.withColumn("_salted", F.struct(*keys, salt.alias("_salt")))
            .withColumn("_rank", F.row_number().over(salted))
            .where(F.col("_rank") <= n)
            .drop("_salted", "_rank")
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= n)
    return out if rank_name else out.drop(rank)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order; copies go in the map tasks."""
    return top_n_per_group(df, keys, order, 1)
