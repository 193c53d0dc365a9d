"""Ranking metrics over scored candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hashing import seeded_hash
from tidemark.names import SEED, TOP_KS
from tidemark.plans.durable import cut
from tidemark.plans.ordered import first_by_hash, ranged, running_before
from tidemark.plans.scalars import row_of

ZERO_HISTORY = "zero_history_"


def discount(position: Column) -> Column:
    """Gain at a 1-based rank."""
    return F.lit(1.0) / F.log2(position + F.lit(1.0))


def discount_sum(n: Column) -> Column:
    """Sum of the first ``n`` gains, the gain of a perfect ranking."""
    steps = F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + discount(i.cast("double")))
    return F.when(n >= 1, total).otherwise(F.lit(0.0))


def ranked(
    scores: DataFrame, keys: Sequence[str], score: str = "score", item: str = "post_id", prefix: str = ""
) -> DataFrame:
    """Rank the candidates of each row and add the counts its metrics need.

    All windows share one partitioning and one sort.  A group is one user-hour and
    its batch candidates.  When the keys begin with those the pairs were joined on,
    no shuffle is needed at all.  Several scores of the same pairs are ranked one after the
    other, each under its ``prefix``, with a sort and no shuffle for each.
    """
    by_rank = Window.partitionBy(*keys).orderBy(F.col(score).desc(), item)
    by_score = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    so_far = by_rank.rowsBetween(Window.unboundedPreceding, 0)
    down_to = by_score.rangeBetween(Window.unboundedPreceding, 0)
    same = by_score.rangeBetween(0, 0)
    places = {
        "rank": F.row_number().over(by_rank),
        "hits": F.sum("label").over(so_far),
        "n_down_to": F.count(F.lit(1)).over(down_to),
        "pos_down_to": F.sum("label").over(down_to),
        "n_same": F.count(F.lit(1)).over(same),
        "pos_same": F.sum("label").over(same),
    }
    return scores.withColumns({prefix + n: c for n, c in places.items()})


def ranking_rows(
    scores: DataFrame,
    keys: Sequence[str],
    top_ks: Sequence[int] = TOP_KS,
    score: str = "score",
    item: str = "post_id",
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per user-hour: counts, ranks of the positives, dcg, ndcg, recall, AP, AUC.

    ``strict_average_precision`` goes by rank order; ``average_precision`` treats
    equal scores as one threshold.  Without positives the gains are 0 and the rest
    is null; AUC also needs a negative.  ``extra`` columns are constant per row.
    """
    placed = sized(ranked(scores, keys, score, item), keys)
    rows = placed.groupBy(*keys).agg(*row_counts(), *row_aggregates(top_ks), *[F.first(c).alias(c) for c in extra])
    return with_gains(rows, top_ks)


def sized(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the candidates and positives of each row."""
    per_key = Window.partitionBy(*keys)
    return placed.withColumns({"_n": F.count(F.lit(1)).over(per_key), "_p": F.sum("label").over(per_key)})


def row_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("candidate_count"), F.sum("label").alias("positive_count")]


def row_aggregates(top_ks: Sequence[int] = TOP_KS, prefix: str = "") -> list[Column]:
    """What the candidates of one row come to under the ranks of ``prefix``."""

    def of(name: str) -> Column:
        return F.col(prefix + name)

    hit = F.col("label") == 1
    rank = of("rank").cast("double")
    below = (F.col("_n") - F.col("_p")) - (of("n_down_to") - of("pos_down_to"))
    auc = (below + (of("n_same") - of("pos_same")) * 0.5) / F.nullif(F.col("_n") - F.col("_p"), F.lit(0))
    values = {
        "positive_rank_min": F.min(F.when(hit, rank)),
        "positive_rank_mean": F.avg(F.when(hit, rank)),
        "positive_rank_max": F.max(F.when(hit, rank)),
        "strict_average_precision": F.avg(F.when(hit, of("hits") / rank)),
        "average_precision": F.avg(F.when(hit, of("pos_down_to") / of("n_down_to"))),
        "auc_roc": F.avg(F.when(hit, auc)),
    }
    for k in top_ks:
        inside = hit & (of("rank") <= k)
        values[f"dcg_at_{k}"] = F.coalesce(F.sum(F.when(inside, discount(rank))), F.lit(0.0))
        values[f"_hits_at_{k}"] = F.count_if(inside)
    return [c.alias(prefix + n) for n, c in values.items()]


def with_gains(rows: DataFrame, top_ks: Sequence[int] = TOP_KS, prefix: str = "") -> DataFrame:
    """Add ndcg and recall from dcg, hits and counts."""
    for k in top_ks:
        k_eff = F.least(F.lit(k), F.col("candidate_count"))
        ideal = discount_sum(F.least(F.col("positive_count"), k_eff))
        hits = F.col(f"{prefix}_hits_at_{k}")
        rows = rows.withColumns(
            {
                f"{prefix}ndcg_at_{k}": F.col(f"{prefix}dcg_at_{k}") / F.greatest(ideal, F.lit(1e-12)),
                f"{prefix}recall_at_{k}": F.coalesce(hits / F.nullif(F.col("positive_count"), F.lit(0)), F.lit(0.0)),
            }
        ).drop(f"{prefix}_hits_at_{k}")
    return rows


def metric_names(top_ks: Sequence[int] = TOP_KS) -> list[str]:
    return [f"{m}_at_{k}" for k in top_ks for m in ("dcg", "ndcg", "recall")]


def rank_metrics(
    rows: DataFrame, by: Sequence[str] = (), top_ks: Sequence[int] = TOP_KS, prefix: str = ""
) -> DataFrame:
    """Means over the rows that have a positive; 0 when there is none."""
    has = F.col("positive_count") > 0

    def mean(col: str, name: str) -> Column:
        return F.coalesce(F.avg(F.when(has, F.col(col))), F.lit(0.0)).alias(prefix + name)

    return rows.groupBy(*by).agg(
        *[mean(m, m) for m in metric_names(top_ks)],
        mean("strict_average_precision", "mean_average_precision"),
        F.count_if(has).alias(prefix + "rank_metric_user_count"),
    )


def zero_history_metrics(
    rows: DataFrame, by: Sequence[str] = (), top_ks: Sequence[int] = TOP_KS, history: str = "num_embedding_likes"
) -> DataFrame:
    """The same means over the rows of users without history."""
    return rank_metrics(rows.where(F.col(history) == 0), by, top_ks, ZERO_HISTORY)


def random_baseline(rows: DataFrame, by: Sequence[str] = (), top_ks: Sequence[int] = TOP_KS) -> DataFrame:
    """Expected metrics of a random order, from the counts of each row alone."""
    n = F.col("candidate_count").cast("double")
    p = F.col("positive_count").cast("double")
    steps = F.sequence(F.lit(1), F.greatest(F.col("candidate_count"), F.lit(1)).cast("int"))
    harmonic = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i.cast("double"))
    expected_ap = F.when(n == 1, F.lit(1.0)).otherwise(
        (harmonic + (n - harmonic) * ((p - 1) / F.nullif(n - 1, F.lit(0.0)))) / n
    )
    columns = {"mean_average_precision": expected_ap}
    for k in top_ks:
        k_eff = F.least(F.lit(k), F.col("candidate_count"))
        dcg = (p / n) * discount_sum(k_eff)
        columns[f"dcg_at_{k}"] = dcg
        columns[f"ndcg_at_{k}"] = dcg / F.greatest(discount_sum(F.least(F.col("positive_count"), k_eff)), F.lit(1e-12))
        columns[f"recall_at_{k}"] = k_eff / n
    with_positive = rows.where(F.col("positive_count") > 0).withColumns({f"_{c}": e for c, e in columns.items()})
    return with_positive.groupBy(*by).agg(
        *[F.coalesce(F.avg(f"_{c}"), F.lit(0.0)).alias(c) for c in columns],
        F.count(F.lit(1)).alias("rank_metric_user_count"),
    )


def threshold_metrics(
    pairs: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """AUC with ties and threshold average precision per group of any size.

    Rows are first counted per distinct score and written in the order of group and
    score.  Only groups that a cut of this order falls into have more than one piece, so
    neither a whole table nor a hot group sits in one task, and many small groups stay whole.
    """
    keys = list(keys)
    counts = ranged(
        pairs.groupBy(*keys, score).agg(F.sum(label).cast("long").alias("_pos"), F.count(F.lit(1)).alias("_all")),
        [*keys, score],
    )
    below = running_before(
        counts, keys, [score], {"_pos_below": F.col("_pos"), "_all_below": F.col("_all")}, placed=True
    )
    totals = counts.groupBy(*keys).agg(F.sum("_pos").alias("_p"), F.sum("_all").alias("_n"))
    if keys:
        joined = below.join(totals, keys)
    else:
        joined = below.withColumn("_t", row_of(totals)).withColumns({"_p": F.col("_t._p"), "_n": F.col("_t._n")})
    neg, neg_below = F.col("_all") - F.col("_pos"), F.col("_all_below") - F.col("_pos_below")
    precision = (F.col("_p") - F.col("_pos_below")) / (F.col("_n") - F.col("_all_below"))
    p, n = F.max("_p"), F.max("_n")
    return joined.groupBy(*keys).agg(
        n.alias("pair_count"),
        p.alias("positive_count"),
        (F.sum(F.col("_pos") * (neg_below + neg * 0.5)) / F.nullif(p * (n - p), F.lit(0))).alias("auc_roc"),
        (F.sum(F.col("_pos") * precision) / F.nullif(p, F.lit(0))).alias("average_precision"),
    )


def pooled_classification(
    pairs: DataFrame,
    pair_keys: Sequence[str],
    max_pairs: int | None = None,
    score: str = "score",
    seed: int = SEED,
) -> DataFrame:
    """AUC and AP over all pairs; only if a caller asks, over ``max_pairs`` drawn by hash order.

    The scored pairs are written once, since they are read for the totals, the draw
    and the metrics.
    """
    pairs = cut(pairs.select(*pair_keys, score, "label"))
    kept = pairs
    if max_pairs is not None:
        hashed = pairs.withColumn("_hash", seeded_hash(seed, "pairs", *pair_keys))
        kept = first_by_hash(hashed, max_pairs, "_hash", list(pair_keys)).drop("_hash")
    everything = row_of(
        pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("p"))
    )
    return (
        threshold_metrics(kept, (), score)
        .withColumn("_all", everything)
        .select(
            F.col("_all.n").alias("classification_metric_pair_count"),
            F.col("_all.p").alias("classification_metric_positive_count"),
            F.col("pair_count").alias("classification_metric_sampled_pair_count"),
            (F.col("_all.n") > F.col("pair_count")).alias("classification_metric_sampled"),
            "auc_roc",
            F.col("average_precision").alias("classification_average_precision"),
        )
    )


def listwise_loss(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean over rows of the cross entropy between labels and softmax scores."""
    group = Window.partitionBy(*keys)
    shifted = scores.withColumn("_shift", F.col(score) - F.max(score).over(group))
    rows = shifted.groupBy(*keys).agg(
        F.ln(F.sum(F.exp("_shift"))).alias("_lse"),
        F.sum("label").alias("_p"),
        F.sum(F.col("label") * F.col("_shift")).alias("_hit"),
    )
    loss = F.when(F.col("_p") > 0, F.col("_lse") - F.col("_hit") / F.col("_p")).otherwise(
        F.raise_error(F.lit("a row without a positive has no listwise loss")).cast("double")
    )
    return rows.select(loss.alias("row_loss")).agg(
        F.avg("row_loss").alias("loss"), F.count(F.lit(1)).alias("n_rows")
    )
