"""Positions and running sums that never put one whole group in one task.

A plain ``Window.partitionBy(key).orderBy(x)`` sorts all rows of a key in one
task, and a window without a key sorts the whole table there.  Here a range
exchange on keys and order deals the rows out first: its own row sample cuts a hot
key in proportion to its share and leaves ordinary keys whole.  A window then works
per ``(key, part)``; the totals of the earlier parts of a key, one small row per key
and part, are added back with a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.durable import cut

MIN_PARTS = 32
#: Column of :func:`ranged`, and its bits for the place inside a part (as Spark numbers rows).
PLACE = "_place"
PLACE_BITS = 33


def parts_of(df: DataFrame) -> int:
    """Pieces that a hot key is cut into: as many as the session gives a shuffle, 32 at least."""
    return max(MIN_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in ascending order, nulls first, written with the part and the place of each as ``_place``.

    One range exchange; no cut point passes through the driver or enters an
    expression, and a written table keeps its places whatever is lost later.
    """
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id()))


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    bucket: Column | None = None,
    placed: bool = False,
) -> DataFrame:
    """Add, per row, each sum over the rows of its group that come earlier.

    ``order`` is ascending, nulls first, and total inside a group.  ``bucket`` may
    be any column that never falls along the order; without it the parts are those of
    :func:`ranged` over keys and order (``placed``: the input comes from there already).
    """
    keys = list(keys)
    if bucket is None:
        df = df if placed else ranged(df, [*keys, *order])
        bucket, order = F.shiftright(PLACE, PLACE_BITS), [PLACE]

    # One struct column: an input already hashed on the keys alone must not be reused,
    # since it would bring a whole hot group into one task.
    cut_rows = df.withColumn("_group", F.struct(*keys, bucket.alias("_bucket")))
    local = Window.partitionBy("_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut_rows.withColumns({n: _or_zero(F.sum(e).over(local)) for n, e in sums.items()})

    # One row per key and part: as many as there are keys, and one more for each cut.
    group_keys = [F.col(f"_group.{k}") for k in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*group_keys).orderBy("_group._bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut_rows.groupBy("_group").agg(*[F.sum(e).alias(f"_total_{n}") for n, e in sums.items()])
    carry = totals.select(
        "_group", *[_or_zero(F.sum(f"_total_{n}").over(earlier)).alias(f"_carry_{n}") for n in sums]
    )
    joined = rows.join(carry, "_group")
    return joined.withColumns({n: F.col(n) + F.col(f"_carry_{n}") for n in sums}).drop(
        "_group", PLACE, *[f"_carry_{n}" for n in sums]
    )


def _or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", bucket: Column | None = None
) -> DataFrame:
    """Add the 0-based position of each row in its group.

    Without keys the parts are counted and their offsets joined back on the part number: one
    exchange in all.
    """
    if keys or bucket is not None:
        return running_before(df, keys, order, {name: F.lit(1).cast("long")}, bucket)
    rows = ranged(df, order).withColumn("_part", F.shiftright(PLACE, PLACE_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select("_part", _or_zero(F.sum("_size").over(earlier)).alias("_offset"))
    inside = F.col(PLACE).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # One row a part of the exchange.
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + inside).drop("_part", "_offset", PLACE)


def hash_bucket(hash_col: str, digits: int = 2) -> Column:
    """Leading hex digits of a hash: even buckets that follow the hash order."""
    return F.substring(hash_col, 1, digits)


def first_by_hash(
    df: DataFrame, n: int | Column, hash_col: str, ties: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` rows with the smallest hash (of each group of ``keys``), ties by the given columns.

    A global ``orderBy.limit(n)`` gathers ``n`` rows from every task in one
    place.  Here 4096 hash buckets are counted, the buckets past ``n`` are dropped
    by a join with that count table, and rows are ranked inside their bucket.  Groups
    must be few, such as splits.
    """
    parts = [*keys, "_bucket"]
    bucketed = df.withColumn("_bucket", hash_bucket(hash_col, 3))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*parts, _or_zero(F.sum("_size").over(earlier)).alias("_before"))
        .where(F.col("_before") < n)
    )
    inside = Window.partitionBy(*parts).orderBy(hash_col, *ties)
    return (
        bucketed.join(F.broadcast(offsets), parts)  # at most 16**3 rows a group
        .withColumn("_rank", F.row_number().over(inside) + F.col("_before"))
        .where(F.col("_rank") <= n)
        .drop("_bucket", "_before", "_rank")
    )


def ranked_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, value, n, below)``: distinct values with their count and the count below.

    The result is written, so that its readers do not run the input again.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return cut(running_before(counts, keys, [value], {"below": F.col("n")}))


def quantiles_of(
    ranked: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], nearest: bool = False
) -> DataFrame:
    """Exact quantiles per group from :func:`ranked_counts`.

    Linear interpolation between the two neighbours by default; ``nearest``
    takes the row at ``round((n - 1) * q)``.
    """
    keys = list(keys)
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("_n"))
    if keys:
        joined = ranked.join(totals, keys)
    else:
        joined = ranked.withColumn("_n", totals.scalar())

    def at(position: Column) -> Column:
        inside = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))

    picks = []
    for name, q in quantiles.items():
        exact = (F.col("_n") - 1) * F.lit(float(q))
        if nearest:
            picks.append(at(F.floor(exact + 0.5)).alias(name))
        else:
            low, high = at(F.floor(exact)), at(F.ceil(exact))
            share = F.max(exact - F.floor(exact))
            picks.append((low + (high - low) * share).cast("double").alias(name))
    return joined.groupBy(*keys).agg(*picks)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], nearest: bool = False
) -> DataFrame:
    """Exact quantiles per group without one task holding a group."""
    return quantiles_of(ranked_counts(df, keys, value), keys, value, quantiles, nearest)
