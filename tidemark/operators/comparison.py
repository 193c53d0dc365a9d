"""Several scorers on the same candidates, as one long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hashing import seeded_hash
from tidemark.names import SEED, TOP_KS
from tidemark.operators import ranking
from tidemark.operators.ranking import metric_names, rank_metrics, threshold_metrics, zero_history_metrics
from tidemark.plans.durable import cut
from tidemark.plans.ordered import first_by_hash
from tidemark.plans.spread import dealt

MODEL = ["model_name", "model_type", "split"]
RANKS = ["mean_average_precision", "rank_metric_user_count"]
POOLED = [
    "auc_roc",
    "classification_average_precision",
    "classification_metric_pair_count",
    "classification_metric_positive_count",
    "classification_metric_sampled_pair_count",
    "classification_metric_sampled",
]


def comparison_metrics(top_ks: Sequence[int] = TOP_KS) -> list[str]:
    """Every metric of the long table."""
    ranks = [*metric_names(top_ks), *RANKS]
    return [*ranks, *[ranking.ZERO_HISTORY + n for n in ranks], "loss", *POOLED]


def model_rows(
    pairs: DataFrame,
    scorers: dict[str, tuple[str, str]],
    keys: Sequence[str],
    top_ks: Sequence[int] = TOP_KS,
    item: str = "post_id",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Ranking rows of every model: ``model_name``, ``model_type`` and the metrics of a user-hour, with its loss.

    A pair stays one row with all its scores.  The models are ranked one after the other
    inside the same groups, and one grouping gives the metrics of all; only the finished rows, one
    for each user-hour, are repeated for each model.
    """
    per_key = Window.partitionBy(*keys)
    wide, aggregates = ranking.sized(dealt(pairs, keys), keys), []
    for j, (_, score) in enumerate(scorers.values()):
        prefix = f"_m{j}_"
        wide = ranking.ranked(wide, keys, score, item, prefix)
        # Softmax scores less their largest, so that no exponential overflows.
        wide = wide.withColumn(f"{prefix}shift", F.col(score) - F.max(score).over(per_key))
        shift = F.col(f"{prefix}shift")
        hit = F.sum(F.col("label") * shift) / F.nullif(F.sum("label"), F.lit(0))
        aggregates += [*ranking.row_aggregates(top_ks, prefix), (F.ln(F.sum(F.exp(shift))) - hit).alias(f"{prefix}loss")]
    rows = wide.groupBy(*keys).agg(*ranking.row_counts(), *aggregates, *[F.first(c).alias(c) for c in extra])
    names = ["strict_average_precision", "average_precision", "auc_roc", *metric_names(top_ks), "loss"]
    models = []
    for j, (name, (kind, _)) in enumerate(scorers.items()):
        prefix = f"_m{j}_"
        rows = ranking.with_gains(rows, top_ks, prefix)
        values = [F.col(prefix + n).alias(n) for n in names]
        models.append(F.struct(F.lit(name).alias("model_name"), F.lit(kind).alias("model_type"), *values))
    kept = [*keys, "candidate_count", "positive_count", *extra]
    return rows.select(*kept, F.explode(F.array(*models)).alias("_m")).select(*kept, "_m.*")


def pooled_metrics(
    pairs: DataFrame,
    scorers: dict[str, tuple[str, str]],
    pair_keys: Sequence[str],
    max_pairs: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """AUC and average precision over all pairs of each model and split.

    ``max_pairs`` draws as many pairs of each split by hash order, the same for all models; the
    counts of all pairs are given as well.  Scores are counted by model and value in the map tasks.
    """
    drawn = pairs
    if max_pairs is not None:
        hashed = pairs.withColumn("_hash", seeded_hash(seed, "pairs", *pair_keys))
        drawn = first_by_hash(hashed, max_pairs, "_hash", list(pair_keys), ["split"])
    entries = [
        F.struct(F.lit(name).alias("model_name"), F.lit(kind).alias("model_type"), F.col(score).cast("double").alias("score"))
        for name, (kind, score) in scorers.items()
    ]
    scored = drawn.select("split", "label", F.explode(F.array(*entries)).alias("_m")).select("split", "label", "_m.*")
    totals = pairs.groupBy("split").agg(
        F.count(F.lit(1)).alias("classification_metric_pair_count"),
        F.sum("label").alias("classification_metric_positive_count"),
    )
    return (
        threshold_metrics(scored, MODEL)
        .join(totals, "split")
        .select(
            *MODEL,
            "auc_roc",
            F.col("average_precision").alias("classification_average_precision"),
            "classification_metric_pair_count",
            "classification_metric_positive_count",
            F.col("pair_count").alias("classification_metric_sampled_pair_count"),
            (F.col("classification_metric_pair_count") > F.col("pair_count")).cast("int").alias("classification_metric_sampled"),
        )
    )


def compare_models(
    pairs: DataFrame,
    scorers: dict[str, tuple[str, str]],
    keys: Sequence[str],
    top_ks: Sequence[int] = TOP_KS,
    item: str = "post_id",
    history: str = "num_embedding_likes",
    max_pairs: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Long table ``model_name, model_type, split, metric, value``.

    ``pairs`` has ``keys`` (which identify a ranked row, ``split`` among them), the item, the label,
    the history length and a score column for each model; ``scorers`` maps a model to its type and that column.
    Metrics: means over ranked rows, the same over rows without history (``zero_history_``), the mean
    listwise loss, and pooled classification (``classification_metric_sampled`` is 0 or 1).  A split without
    rows has no metrics and so does not appear; a metric that is not defined is null.

    The pairs are written once, a row each, since ranks and pooled metrics both read them and
    scoring is the costly part.
    """
    scores = list(dict.fromkeys(score for _, score in scorers.values()))
    pairs = cut(pairs.select(*keys, item, "label", history, *scores))
    rows = cut(model_rows(pairs, scorers, keys, top_ks, item, [history]))  # a row for each user-hour and model
    losses = rows.where("positive_count > 0").groupBy(*MODEL).agg(F.avg("loss").alias("loss"))
    zero = zero_history_metrics(rows, MODEL, top_ks, history)
    wide = (
        rank_metrics(rows, MODEL, top_ks)
        .join(zero, MODEL, "left")
        .join(losses, MODEL, "left")
        .join(pooled_metrics(pairs, scorers, [*keys, item], max_pairs, seed), MODEL)
    )
    names = comparison_metrics(top_ks)
    # Without a row of that kind the means are those of no rows.
    filled = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names if n.startswith(ranking.ZERO_HISTORY)}
    return wide.select(*MODEL, *[filled.get(n, F.col(n).cast("double")).alias(n) for n in names]).unpivot(
        MODEL, names, "metric", "value"
    )
