"""Joins whose large side may hold one key very often.

A sketch of frequent keys, counted in the map tasks and merged, names the keys with more than an even
part of the rows.  Only their rows are dealt over several tasks, and only their rows of the other
side are repeated, once for each part; all other keys join as ever.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ordered import parts_of
from tidemark.plans.sizes import broadcast_if_bounded

#: Counters of the sketch for each part; counts err by less than a part's rows divided by about this.
COUNTERS_PER_PART = 16
LEAST_COUNTERS = 1024
MOST_COUNTERS = 1_000_000


#: Parts of :func:`dealt` for each of a shuffle.
PARTS_EACH = 4


def dealt(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` hashed on the columns into a fixed number of parts, more than a shuffle has.

    For rows that grow many times over in the same stage, in a join by batch or with their vectors: adaptive
    execution would put parts together by the size of the narrow rows, and their sorts would spill.
    """
    return df.repartition(PARTS_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)


def _hash(on: Sequence[str]):
    return F.xxhash64(*[F.col(f"`{c}`") for c in on])


def heavy_keys(df: DataFrame, on: Sequence[str], parts: int | None = None) -> DataFrame | None:
    """``(_heavy, _copies)``: hashes of the keys with more than ``1 / parts`` of the rows, and their even shares.

    None if there is no such key.  At most ``parts`` rows come to the driver.  A key that is missed
    or named in vain changes the balance of a join, never its result.
    """
    parts = parts or parts_of(df)
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, COUNTERS_PER_PART * parts))
    keyed = df.select(_hash(on).alias("key"))
    sketch = F.call_function("approx_top_k", F.col("key"), F.lit(min(parts, counters)), F.lit(counters))
    row = keyed.agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    found = [(t["item"], -(-t["count"] * parts // row["n"])) for t in row["top"] or [] if t["count"] * parts > row["n"]]
    if not found:
        return None
    return df.sparkSession.createDataFrame(found, "_heavy long, _copies long")


def spread_join(
    big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner", measured: DataFrame | None = None
) -> DataFrame:
    """``big.join(small, on, how)`` for ``inner``, ``left``, ``left_semi`` and ``left_anti``, with hot keys of ``big`` parted.

    ``measured`` is read for the frequent keys instead of ``big``, where that is cheaper: a written table
    with the same columns ``on`` in about the same shares.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot repeat rows of its right side")
    on = [on] if isinstance(on, str) else list(on)
    heavy = heavy_keys(big if measured is None else measured, on)
    if heavy is None:
        return big.join(small, on, how)
    known = F.broadcast(heavy)  # at most one row a part
    # The same row takes the same part again after a lost executor; equal rows part by their task.
    plain = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    other = [F.col(f"`{f.name}`") for f in big.schema if f.name not in on and not isinstance(f.dataType, plain)]
    deal = F.pmod(F.xxhash64(F.lit(0), *other) + F.spark_partition_id(), F.col("_copies"))
    parted = big.join(known, _hash(on) == F.col("_heavy"), "left")
    parted = parted.withColumn("_part", F.coalesce(deal, F.lit(0).cast("long"))).drop("_heavy", "_copies")
    last = F.coalesce(F.col("_copies") - 1, F.lit(0).cast("long"))
    copies = small.join(known, _hash(on) == F.col("_heavy"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return parted.join(copies.drop("_heavy", "_copies"), [*on, "_part"], how).drop("_part")


def lookup_join(
    big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner", row_bytes: int | None = None
) -> DataFrame:
    """``spread_join``, or with the whole of ``small`` sent to the tasks if its rows, counted, are within the broadcast limit.

    ``row_bytes`` bounds the bytes of a row; without it nothing is counted.  The rows of ``big`` stay where they are then.
    """
    if row_bytes is not None:
        sent, bounded = broadcast_if_bounded(small, small.count(), row_bytes)
        if bounded:
            return big.join(sent, on, how)
    return spread_join(big, small, on, how)


def semi_join_spread(df: DataFrame, keys: DataFrame, on: str, measured: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, with the copies of a hot key on many tasks."""
    return spread_join(df, keys.select(on).distinct(), on, "left_semi", measured)
