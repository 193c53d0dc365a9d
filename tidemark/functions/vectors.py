"""Vector and list columns: selection, padding, summaries, scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.names import AUTHOR_PAD, AUTHOR_UNK, EMA_ALPHA


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pick_embedding(embeddings: Column | str, model: str) -> Column:
    """Value of the first ``{key, value}`` element whose key is the model, else null."""
    return F.try_element_at(F.filter(_col(embeddings), lambda e: e["key"] == model), F.lit(1))["value"]


def padded(values: Column | str, length: int, pad: Column) -> Column:
    """Cut or fill a list to a fixed length."""
    return F.slice(F.concat(_col(values), F.array_repeat(pad, length)), 1, length)


def padding_mask(values: Column | str, length: int) -> Column:
    """True where the padded list holds a real entry."""
    size = F.size(_col(values))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= size)


def padded_authors(values: Column | str, length: int) -> Column:
    return padded(values, length, F.lit(AUTHOR_PAD))


def padded_vectors(vectors: Column | str, length: int, dim: int) -> Column:
    """Zero-padded vectors; a vector of another length is an error."""
    checked = F.transform(
        _col(vectors),
        lambda v: F.when(F.size(v) == dim, v).otherwise(
            F.raise_error(F.concat(F.lit("vector length does not match "), F.lit(str(dim)))).cast("array<float>")
        ),
    )
    return padded(checked, length, F.array_repeat(F.lit(0.0).cast("float"), dim))


def aligned_or_error(values: Column | str, reference: Column | str, name: str) -> Column:
    """``values`` when it is as long as ``reference``; an error otherwise."""
    values, reference = _col(values), _col(reference)
    return F.when(F.size(values) == F.size(reference), values).otherwise(
        F.raise_error(F.lit(f"{name} does not match the history length"))
    )


def or_filled(values: Column | str, reference: Column | str, fill: Column) -> Column:
    """``values``, or a list of ``fill`` as long as ``reference`` when it is null."""
    return F.coalesce(_col(values), F.transform(_col(reference), lambda _: fill))


def author_or_unknown(author: Column | str) -> Column:
    return F.coalesce(F.nanvl(_col(author).cast("double"), F.lit(None).cast("double")), F.lit(float(AUTHOR_UNK))).cast("int")


def authors_or_unknown(authors: Column | str) -> Column:
    return F.transform(_col(authors), author_or_unknown)


def count_or_zero(count: Column | str) -> Column:
    number = _col(count).cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(0.0))


def counts_or_zero(counts: Column | str) -> Column:
    return F.transform(_col(counts), count_or_zero)


def dot(a: Column | str, b: Column | str, dim: int | None = None) -> Column:
    """Inner product in double precision.

    With ``dim`` two vectors of that length are multiplied in one compiled expression, entry by
    entry in the same order, instead of a lambda per entry; others take the general way.
    """
    a, b = _col(a), _col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    general = F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
    if dim is None:
        return general
    total = F.lit(0.0)
    for i in range(dim):
        total = total + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
    return F.when((F.size(a) == dim) & (F.size(b) == dim), total).otherwise(general)


def dot_score(a: Column | str, b: Column | str, temperature: float = 1.0, dim: int | None = None) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return dot(a, b, dim) / F.lit(float(temperature))


def l2_normalised(vector: Column | str, enabled: bool = True) -> Column:
    """Unit vector; the norm is floored so that a zero vector stays zero."""
    if not enabled:
        return _col(vector)
    vector = _col(vector)
    norm = F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def scaled_log_count(count: Column | str, mean: float = 0.0, std: float = 1.0) -> Column:
    """``log(1 + count)``, centred and scaled; negative counts become 0."""
    return (F.log1p(F.greatest(_col(count).cast("double"), F.lit(0.0))) - F.lit(mean)) / F.lit(std)


# -- history summaries -----------------------------------------------------


def _mean_weight(position: Column, length: Column) -> Column:
    return F.lit(1.0)


def _linear_weight(position: Column, length: Column) -> Column:
    return (length - position).cast("double")


def ema_weight(alpha: float = EMA_ALPHA):
    if not 0.0 < alpha <= 1.0:
        raise ValueError(f"alpha must be in (0, 1], got {alpha}")

    def weight(position: Column, length: Column) -> Column:
        return F.lit(float(alpha)) * F.pow(F.lit(1.0 - alpha), position.cast("double"))

    return weight


def weight_of(kind: str, ema_alpha: float = EMA_ALPHA):
    """Weight of history position ``i`` (0 = most recent) in a list of length ``n``."""
    weights = {"mean": lambda: _mean_weight, "ema": lambda: ema_weight(ema_alpha), "linear_recency": lambda: _linear_weight}
    if kind not in weights:
        raise ValueError(f"unknown summary {kind!r}; known: {', '.join(sorted(weights))}")
    return weights[kind]()


def _weighted_mean(dim: int):
    """Weighted mean of a list of vectors with a list of weights, on Arrow batches, added from the first vector on.

    Null where a vector has a null entry or another length than ``dim``, and for empty lists.
    """

    def run(vectors: pa.Array, weights: pa.Array) -> pa.Array:
        size = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, factors = vectors.flatten(), weights.flatten().to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(rows).fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
        known = lengths == dim
        values = rows.flatten()
        # Entries of the vectors of the right length, in rows; the others stay zero and make their list null.
        table = np.zeros((len(rows), dim))
        if dim:
            inside = np.repeat(known, np.maximum(lengths, 0))
            table[known] = values.to_numpy(zero_copy_only=False)[inside].reshape(-1, dim)
        holes = np.zeros(len(rows), bool)
        if dim and values.null_count:
            missing = values.is_null().to_numpy(zero_copy_only=False)[inside].reshape(-1, dim)
            holes[known] = missing.any(axis=1)
        table *= factors[:, None]
        total, weight_sum = np.zeros((len(size), dim)), np.zeros(len(size))
        for place in range(int(size.max(initial=0))):
            longer = size > place
            total[longer] += table[first[longer] + place]
            weight_sum[longer] += factors[first[longer] + place]
        total /= np.maximum(weight_sum, 1e-12)[:, None]
        odd = np.zeros(len(size), bool)
        odd[np.repeat(np.arange(len(size)), size)[~known | holes]] = True
        offsets = np.arange(len(size) + 1, dtype=np.int32) * dim
        mask = pa.array(odd | (size == 0))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.reshape(-1)), mask=mask)

    return F.arrow_udf(run, "array<double>")


def summary_vector(
    vectors: Column | str, dim: int, kind: str = "mean", ema_alpha: float = EMA_ALPHA, padded_length: int | None = None
) -> Column:
    """Weighted mean of a list of vectors, newest first; the zero vector when empty.

    With ``padded_length`` the list is cut to that length and the weights run over
    the padded length, as they do for fixed-length batches.
    """
    weight = weight_of(kind, ema_alpha)
    vectors = _col(vectors)
    if padded_length is not None:
        vectors = F.slice(vectors, 1, padded_length)
    size = F.size(vectors)
    length = F.lit(padded_length) if padded_length is not None else size
    zeros = F.array_repeat(F.lit(0.0), dim)
    weights = F.transform(vectors, lambda _, i: weight(i, length))
    # Vectors with a null entry or of another length, seen as null above, go the general way.
    weighted = F.zip_with(vectors, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    general = F.aggregate(
        weighted, zeros, lambda acc, e: F.zip_with(acc, e["v"], lambda a, x: a + x.cast("double") * e["w"])
    )
    weight_sum = F.greatest(F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w), F.lit(1e-12))
    mean = F.coalesce(_weighted_mean(dim)(vectors, weights), F.transform(general, lambda x: x / weight_sum))
    return F.when(size > 0, mean).otherwise(zeros)
