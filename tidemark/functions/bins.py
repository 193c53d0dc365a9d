"""History-length bins and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.names import BIN_EDGES


def bin_labels(edges: Sequence[int] = BIN_EDGES) -> list[str]:
    """Labels of left-closed bins; the last one is open."""
    labels = [str(low) if high - low == 1 else f"{low}-{high - 1}" for low, high in zip(edges, edges[1:])]
    return [*labels, f"{edges[-1]}+"]


def bin_index(count: Column | str, edges: Sequence[int] = BIN_EDGES) -> Column:
    """Bin number of a count; null below the first edge."""
    count = F.col(count) if isinstance(count, str) else count
    result = F.when(count >= edges[-1], len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        result = result.when(count >= edges[i], i)
    return result


def bin_label(index: Column | str, edges: Sequence[int] = BIN_EDGES) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.element_at(F.array(*[F.lit(label) for label in bin_labels(edges)]), index + 1)


def decision(probability: Column | str) -> Column:
    """1 iff the probability is above one half."""
    probability = F.col(probability) if isinstance(probability, str) else probability
    return (probability > 0.5).cast("int")
