"""Seeded hashes, uniforms and sampling scores that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, salt: str, *keys: Column | str) -> Column:
    """Pseudo-random hex key of the given columns; text order is numeric order.

    A null key has a mark of its own, so that it cannot shift the keys behind it.
    """
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{salt}"), *[_as_text(k) for k in keys]))


def _as_text(key: Column | str) -> Column:
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("\u0000"))


def leading_number(hash_col: Column) -> Column:
    """The first eight hex digits as a number below 2**32."""
    return F.conv(F.substring(hash_col, 1, 8), 16, 10).cast("double")


def uniform(hash_col: Column) -> Column:
    """A uniform in the open interval (0, 1)."""
    return (leading_number(hash_col) + F.lit(0.5)) / F.lit(2.0**32)


def bernoulli(hash_col: Column, share: float) -> Column:
    """Keep about ``share`` of the keys; 0 keeps none, 1 keeps all."""
    if share <= 0:
        return F.lit(False)
    return leading_number(hash_col) / F.lit(2.0**32) < F.lit(float(share))


def candidate_sample(item: Column | str, share: float, seed: int) -> Column:
    """The posts that may serve as negatives, a pure function of the address."""
    return bernoulli(seeded_hash(seed, "candidate", item), share)


def sample_score(u: Column, count: Column | str, alpha: float) -> Column:
    """Exponential key of weighted sampling: the smallest win, weight ``count ** alpha``."""
    count = F.col(count) if isinstance(count, str) else count
    return -F.ln(u) / F.pow(count.cast("double"), F.lit(float(alpha)))
