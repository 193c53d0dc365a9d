"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic, everything else is unlabelled: a
missing or negative label teaches nothing by itself.  With the share ``prior`` of
toxic documents, the risk of a linear classifier is

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

for the logistic loss; where the bracket falls below zero the step goes back up
its gradient instead, so that positives hidden among the unlabelled are not
learnt as negatives.  A few classifiers learn from samples of their own, one
Spark task each, and their margins are averaged.

The labelled rows need not hold as many toxic ones as the documents do.  So ``prior`` is
estimated for the unlabelled sample: a plain classifier of one half of the labelled rows scores the
other half and the unlabelled, and the share of toxic scores that explains the latter as a mixture is the
prior.  Texts that are much alike count once, so that a passage copied many times does not make what is
learnt.  At the end the margins are turned into chances on labelled rows that a member has not
learnt from, so that 0.5 means the same whatever the prior.

Features are the distinct words of a text and the beginnings of its words, hashed
to a table; proximal steps keep most weights at zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.blocks import pack, pack_sorted, unpack, unpack_sorted
from tidemark.llm.rows import appended, fresh, schema_with, steps, text_buffer
from tidemark.llm.words import distinct, hash_words, lower_table, spans
from tidemark.plans.durable import cut

#: Bounds of the training sample, confirmed positives, confirmed negatives and unlabelled, over all members.
MAX_POSITIVES, MAX_NEGATIVES, MAX_UNLABELLED = 6000, 6000, 18000
MEMBERS = 3
DIMENSIONS = 1 << 20
#: Lengths in bytes of the word beginnings among the features.
PREFIXES = (5, 6, 7, 9)
#: Texts among a member's positives that a feature must stand in.
LEAST_POSITIVES = 3
#: Absolute penalty in units of ``prior / sqrt(positives)``, square penalty, and steps of a run.
PENALTY, RIDGE, STEPS = 0.1, 1e-4, 150
FOLDS = 5
#: Text that is scored at a time: a word makes five features.
STEP_BYTES = 1 << 20
#: Bins of scores and steps for the prior, bounds of a prior, and labelled rows of each sort that it takes.
BINS, MIXING, LEAST_PRIOR, MOST_PRIOR, LEAST_LABELLED = 12, 200, 1e-4, 0.9, 8
POSITIVE, NEGATIVE, UNLABELLED = 1, 2, 0
#: Bands of three minima that tell texts which are much alike.
COPY_BANDS = 4


class Weights(NamedTuple):
    """Sum of the members' tables, and of their biases, divided by their number."""

    table: np.ndarray
    bias: float


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, feature)`` of every word and word beginning, kind by kind, with repeats."""
    data = lower_table()[data]
    starts, ends, firsts = spans(data, offsets, "alnum")
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    for seed, length in enumerate((None, *PREFIXES), start=11):
        own = starts if length is None else starts[ends - starts > length]
        where = text if length is None else text[ends - starts > length]
        stop = ends if length is None else own + length
        yield where, (hash_words(data, own, stop, seed) % np.uint64(DIMENSIONS)).astype(np.int64)


def margins(data: np.ndarray, offsets: np.ndarray, weights: Weights) -> np.ndarray:
    """Margin of each text; a feature counts once."""
    kept = []
    for where, feature in features(data, offsets):
        used = weights.table[feature] != 0
        kept.append(where[used] * DIMENSIONS + feature[used])
    pairs = distinct(np.concatenate(kept))
    sums = np.bincount(pairs // DIMENSIONS, weights=weights.table[pairs % DIMENSIONS], minlength=len(offsets) - 1)
    return sums + weights.bias


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """``(features, weights, bias)`` of one member; texts are given as arrays of distinct features.

    Accelerated proximal gradient steps on the whole sample.  A first run with an
    absolute penalty picks features; a second one over those, with a light square
    penalty, takes back how much the first has shrunk them.
    """
    return _fit(positive, unlabelled, prior, corrected=True)


def _fit(positive: list[np.ndarray], other: list[np.ndarray], prior: float, corrected: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """As :func:`fit`; not ``corrected``: ``other`` are confirmed negatives."""
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not other:
        return np.zeros(0, np.int64), np.zeros(0), bias
    rows = positive + other
    flat = np.concatenate(rows)
    inside = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    first = np.arange(len(rows)) < len(positive)
    # A feature must be able to pay its penalty, and must not stand in most texts that are not toxic.
    n_positive = np.bincount(flat[first[inside]], minlength=DIMENSIONS)
    n_other = np.bincount(flat[~first[inside]], minlength=DIMENSIONS)
    hidden = prior * len(other) if corrected else 0.0
    used = np.flatnonzero((n_positive >= LEAST_POSITIVES) & (n_other <= hidden + (len(other) - hidden) / 2))
    penalty = prior * PENALTY / np.sqrt(len(positive))
    weights = np.zeros(len(used))
    for absolute, square in ((penalty, 0.0), (0.0, RIDGE)):
        number = np.full(DIMENSIONS, -1, np.int32)
        number[used] = np.arange(len(used))
        own = number[flat]
        weights, bias = _descend(inside[own >= 0], own[own >= 0], first, prior, weights, bias, absolute, square, corrected)
        used, weights = used[weights != 0], weights[weights != 0]
    return used, weights, bias


def without_near_copies(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The texts without those that share a band of minima with an earlier one; such as are much alike count once.

    Two texts with a share ``s`` of their features in common go on as one with a chance of ``1 - (1 - s**3)**4``: 0.94 at
    0.8, and one in eight at 0.3.
    """
    factors = np.random.default_rng(5).integers(0, 2**63, 3 * COPY_BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[bytes] = set()
    kept = []
    for row in rows:
        if len(row):
            mixed = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bands = (factors[:, None] * (mixed ^ mixed >> np.uint64(29))).min(axis=1).reshape(COPY_BANDS, 3)
        else:
            bands = np.zeros((COPY_BANDS, 3), np.uint64)
        keys = {bytes([k]) + band.tobytes() for k, band in enumerate(bands)}
        if not keys & seen:
            kept.append(row)
        seen |= keys
    return kept


def _margins(rows: list[np.ndarray], model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    used, weights, bias = model
    table = np.zeros(DIMENSIONS)
    table[used] = weights
    return np.array([table[r].sum() for r in rows]) + bias


def mixed_share(positive: np.ndarray, negative: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of ``unlabelled`` scores that come from where ``positive`` ones do, the rest from the ``negative`` ones."""
    edges = np.unique(np.quantile(np.concatenate([positive, negative, unlabelled]), np.arange(1, BINS) / BINS))
    density = [np.bincount(np.searchsorted(edges, x), minlength=len(edges) + 1) + 0.5 for x in (positive, negative)]
    counts = np.bincount(np.searchsorted(edges, unlabelled), minlength=len(edges) + 1)
    p, q = (d / d.sum() for d in density)
    share = 0.5
    for _ in range(MIXING):
        chance = share * p / (share * p + (1 - share) * q)
        share = float((counts * chance).sum() / counts.sum())
    return share


def estimated_prior(
    positive: list[np.ndarray], negative: list[np.ndarray], unlabelled: list[np.ndarray], labelled_share: float
) -> float:
    """The share of toxic texts among the unlabelled; that of the labels if there are too few labelled rows or no unlabelled.

    Each half of the labelled rows is scored by a classifier of the other half.
    """
    share = labelled_share
    if min(len(positive), len(negative)) >= LEAST_LABELLED and unlabelled:
        found = []
        for half in (0, 1):
            model = _fit(positive[half::2], negative[half::2], 0.5, corrected=False)
            found.append(mixed_share(*(_margins(rows, model) for rows in (positive[1 - half :: 2], negative[1 - half :: 2], unlabelled))))
        share = float(np.mean(found))
    return min(max(share, LEAST_PRIOR), MOST_PRIOR)


def _descend(row, column, first, prior, weights, bias, absolute, square, corrected=True) -> tuple[np.ndarray, float]:
    """Minimise the risk over the entries ``(row, column)``; ``first`` marks positives.

    ``corrected``: the non-negative risk, the others being unlabelled; else they are negatives.
    """
    share = np.where(first, 1 / first.sum(), 1 / (~first).sum())
    scale = np.where(first, 2 * prior, 1) * share

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        margin = np.clip(b + np.bincount(row, weights=w[column], minlength=len(first)), -30, 30)
        chance = 1 / (1 + np.exp(-margin))
        negative = np.logaddexp(0, margin) * share
        bracket = negative[~first].sum() - prior * negative[first].sum()
        up = np.where(first, prior * share * (chance - 1), 0)  # by the margin, of prior * R+
        if not corrected:
            slope = up + np.where(first, 0, (1 - prior) * share * chance)
        else:
            down = np.where(first, -prior * share * chance, share * chance)  # of the bracket
            slope = up + down if bracket >= 0 else up - down
        return np.bincount(column, weights=slope[row], minlength=len(w)) + square * w, float(slope.sum())

    # The largest curvature, by power iteration, bounds the step.
    direction, top = np.ones(len(weights)) / max(1, len(weights)) ** 0.5, 1.0
    for _ in range(12):
        image = np.bincount(row, weights=direction[column], minlength=len(first)) * scale
        direction = np.bincount(column, weights=image[row], minlength=len(weights))
        top = max(float(np.linalg.norm(direction)), 1e-9)
        direction = direction / top
    rate = 1 / (0.25 * (top + 1) * 1.1 + square)
    ahead, ahead_bias, momentum = weights, bias, 1.0
    for _ in range(STEPS):
        slope, slope_bias = gradient(ahead, ahead_bias)
        moved = ahead - rate * slope
        moved = np.sign(moved) * np.maximum(np.abs(moved) - rate * absolute, 0)
        moved_bias = ahead_bias - rate * slope_bias
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = moved + (momentum - 1) / following * (moved - weights)
        ahead_bias = moved_bias + (momentum - 1) / following * (moved_bias - bias)
        weights, bias, momentum = moved, moved_bias, following
    return weights, bias


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the distinct ids, by hash."""
    return ids.distinct().orderBy(F.xxhash64("key", F.lit(7)), "key").limit(most)


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    folds: int = FOLDS,
    max_positives: int = MAX_POSITIVES,
    max_negatives: int = MAX_NEGATIVES,
    max_unlabelled: int = MAX_UNLABELLED,
    members: int = MEMBERS,
) -> Weights:
    """Learn from the rows whose fold is not 0.

    The sample is bounded: ``max_positives`` of the confirmed toxic documents, ``max_negatives`` of the others that are
    labelled and ``max_unlabelled`` of all documents, by a hash of the id.  The negatives serve the estimate of
    the prior and, with the positives, the scale of the scores, where members judge rows that they have not learnt
    from.  The driver gets each member's nonzero weights and a margin for each labelled row of the sample.
    """
    spark = docs.sparkSession
    key = F.col(f"`{doc_id}`")
    known = labels.where((fold(key, folds) != 0) & F.col(f"`{toxic}`").isNotNull()).select(
        key.alias("key"), (F.col(f"`{toxic}`") == 1).alias("toxic")
    )
    labelled_share = known.agg(F.avg(F.col("toxic").cast("int"))).first()[0] or 0.0
    rows = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text")).where(fold(F.col("key"), folds) != 0)
    parts = (
        (known.where("toxic").select("key"), max_positives, POSITIVE),
        (known.where("NOT toxic").select("key"), max_negatives, NEGATIVE),
        (rows.select("key"), max_unlabelled, UNLABELLED),
    )
    chosen = None
    for ids, most, side in parts:
        part = _sample(ids, most).withColumn("side", F.lit(side))
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most max_positives + max_negatives + max_unlabelled ids.
    sampled = rows.where(F.col("key").isNotNull()).join(F.broadcast(chosen), "key")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            parts = list(features(*text_buffer(batch.column("text"))))
            pairs = distinct(np.concatenate([where * DIMENSIONS + feature for where, feature in parts]))
            points = np.searchsorted(pairs, np.arange(1, batch.num_rows) * DIMENSIONS)
            packed = [pack_sorted((x % DIMENSIONS).astype(np.uint64)) for x in np.split(pairs, points)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("side"), pa.array(packed, pa.binary())],
                names=["key", "side", "features"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    gathered = sampled.mapInArrow(gather, f"key {kind}, side int, features binary")
    # An id may stand on many rows; one of them is enough, and equal texts count once.
    gathered = gathered.groupBy("key", "side").agg(F.min("features").alias("features"))
    gathered = gathered.groupBy("side", "features").agg(F.min("key").alias("key"))
    gathered = cut(gathered.withColumn("member", F.pmod(F.xxhash64("key"), F.lit(members)).cast("int")))

    def fit_member(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending")])
        sides: dict[int, list[np.ndarray]] = {POSITIVE: [], NEGATIVE: [], UNLABELLED: []}
        for side, packed in zip(table.column("side").to_pylist(), table.column("features").to_pylist()):
            sides[side].append(unpack_sorted(packed).astype(np.int32))
        sides = {side: without_near_copies(rows) for side, rows in sides.items()}
        prior = estimated_prior(sides[POSITIVE], sides[NEGATIVE], sides[UNLABELLED], labelled_share)
        used, weights, bias = fit(sides[POSITIVE], sides[UNLABELLED], prior)
        columns = {"at": pack_sorted(used.astype(np.uint64)), "weights": pack(weights.astype(np.float32))}
        return pa.table({"member": table.column("member").slice(0, 1), **{k: pa.array([v], pa.binary()) for k, v in columns.items()}, "bias": pa.array([bias])})

    fitted = cut(gathered.groupBy("member").applyInArrow(fit_member, "member int, at binary, weights binary, bias double"))
    models = {}
    for row in fitted.collect():  # one row per member
        models[row["member"]] = unpack_sorted(row["at"]).astype(np.int64), unpack(row["weights"]).astype(float), row["bias"]
    if not models:
        prior = min(max(labelled_share, LEAST_PRIOR), MOST_PRIOR)
        return Weights(np.zeros(DIMENSIONS), float(np.log(prior / (1 - prior))))
    shared = spark.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [unpack_sorted(packed).astype(np.int64) for packed in batch.column("features").to_pylist()]
            own = batch.column("member").to_numpy()
            # A row is scored by the members that have not learnt from it.
            margin = sum(np.where(own != m, _margins(rows, model), 0.0) for m, model in shared.value.items())
            yield pa.RecordBatch.from_arrays([batch.column("side"), pa.array(margin)], names=["side", "margin"])

    scale, shift = 1.0, 0.0
    if len(models) > 1:
        judged = gathered.where(F.col("side") != UNLABELLED).select("side", "member", "features").mapInArrow(judge, "side int, margin double").toPandas()
        by_side = [judged["margin"][judged["side"] == side].to_numpy() / (len(models) - 1) for side in (POSITIVE, NEGATIVE)]
        scale, shift = calibrated(*by_side)
    table = np.zeros(DIMENSIONS)
    for used, weights, _ in models.values():
        table[used] += weights * scale / len(models)
    return Weights(table, scale * float(np.mean([m[2] for m in models.values()])) + shift)


def calibrated(positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """``(scale, shift)`` that turn margins into log odds of the labels: logistic regression with one input.

    Toxic rows are fewer, and to miss one is worse than to doubt a clean one: they weigh as if there were the
    geometric mean of both numbers.  Targets keep a little off 0 and 1, so that margins which part the labels cleanly have a solution; margins as they
    are where labelled rows are few or say the opposite.
    """
    if min(len(positive), len(negative)) < LEAST_LABELLED:
        return 1.0, 0.0
    margin = np.concatenate([positive, negative])
    target = np.repeat([(len(positive) + 1) / (len(positive) + 2), 1 / (len(negative) + 2)], [len(positive), len(negative)])
    weight = np.repeat([max(1.0, (len(negative) / len(positive)) ** 0.5), 1.0], [len(positive), len(negative)])
    middle, spread = float(margin.mean()), float(margin.std()) or 1.0
    x, (a, b) = (margin - middle) / spread, (1.0, 0.0)
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        slope = np.array([(weight * (chance - target) * x).sum() + 1e-3 * a, (weight * (chance - target)).sum()])
        w = weight * np.maximum(chance * (1 - chance), 1e-6)
        curvature = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(curvature, slope)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a / spread, b - a * middle / spread) if a > 0 else (1.0, 0.0)


def add_score(docs: DataFrame, weights: Weights, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the score of each whole text, and that column's name."""
    name = fresh(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS doubles

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, STEP_BYTES):
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            margin = margins(data, offsets, shared.value)
            yield appended(batch, **{name: pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))})

    return docs.mapInArrow(add, schema_with(docs, (name, T.DoubleType()))), name


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document.

    ``score`` is the chance that the text is toxic, ``predicted`` is 1 from 0.5 on;
    rows of fold 0 are held out from learning.  Ids, languages and sources are no
    features.

    Null and empty texts score by the bias alone; null ids are scored and not
    learnt from; of an id's repeated rows one is learnt from; without confirmed
    positives every score is the prior; an empty table gives no rows; other columns
    are not read.
    """
    rows = docs.select("doc_id", "text")
    scored, name = add_score(rows, train(rows, labels, folds=folds, **options))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == 0).alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those that score 0.5 or more; columns unchanged.

    Null and empty texts score by the bias alone and stay unless most documents are toxic; null ids and repeated rows are
    judged by their text each; without confirmed positives all stay; an empty table gives none.
    """
    scored, name = add_score(docs, train(docs, labels, **options))
    return scored.where(F.col(f"`{name}`") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
