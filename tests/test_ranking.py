"""Candidates, labels, ranking metrics, evaluation, retrieval, pairs."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.operators import candidates as cand
from tidemark.operators import comparison, coverage, evaluation, inequality, pairs, profile, ranking, retrieval

HOUR = datetime(2024, 1, 1, 10)


def likes_table(spark, rows):
    """Rows of (user, post, hour, split, author)."""
    return spark.createDataFrame(
        [
            (u, p, datetime(2024, 1, 1, h, 5), s, datetime(2024, 1, 1, h), int(p[1:]), 10 + int(p[1:]), a)
            for u, p, h, s, a in rows
        ],
        "did string, subject_uri string, record_created_at timestamp, split string, like_hour_bucket timestamp,"
        " emb_idx int, prior_cumulative_likes long, author_idx int",
    )


def posts_table(spark, rows):
    """Rows of (post, hour, window, sampled)."""
    return spark.createDataFrame(
        [(p, sampled, datetime(2024, 1, 1, h) if h is not None else None, w, i + 50, 3, None) for i, (p, h, w, sampled) in enumerate(rows)],
        "at_uri string, in_random_sample boolean, negative_hour_bucket timestamp, split_window string, emb_idx int,"
        " prior_cumulative_likes long, author_idx int",
    )


LIKES = [
    ("u1", "p1", 10, "train", 4),
    ("u1", "p2", 10, "train", None),
    ("u2", "p3", 10, "train", 5),
    ("u3", "p4", 11, "train", 6),
    ("u4", "p5", 13, "val_unseen_users", 6),
]
POSTS = [
    ("n1", 10, "train", True),
    ("p2", 10, "train", True),
    ("n2", 11, "train", True),
    ("nv", 13, "val", True),
    ("nh", 13, "holdout", True),
    ("p9", None, "train", False),
]


def test_candidates_and_labels(spark):
    batched = cand.assign_batches(cand.user_hours(likes_table(spark, LIKES)), 10)
    sets = cand.candidate_sets(batched, likes_table(spark, LIKES), posts_table(spark, POSTS))
    by_hour = {}
    for r in sets.collect():
        by_hour.setdefault((r.split, r[N.HOUR].hour), {})[r.post_id] = r
    assert set(by_hour[("train", 10)]) == {"p1", "p2", "p3", "n1"}
    assert set(by_hour[("train", 11)]) == {"p4", "n2"}
    assert set(by_hour[("val_unseen_users", 13)]) == {"p5", "nv"}
    both = by_hour[("train", 10)]["p2"]
    assert both.from_likes and both.emb_idx == 2 and both[N.AUTHOR_IDX] == N.AUTHOR_UNK and both[N.PRIOR] == 12.0
    labels = {
        (r.did, r.post_id): r.label
        for r in cand.labelled_pairs(batched, sets).where("hour(like_hour_bucket) = 10").collect()
    }
    assert labels == {
        ("u1", "p1"): 1, ("u1", "p2"): 1, ("u1", "p3"): 0, ("u1", "n1"): 0,
        ("u2", "p1"): 0, ("u2", "p2"): 0, ("u2", "p3"): 1, ("u2", "n1"): 0,
    }


def test_batches_limit_who_shares_candidates(spark):
    likes = likes_table(spark, [(f"u{i}", f"p{i}", 10, "train", 1) for i in range(25)])
    hours = cand.user_hours(likes)
    batched = cand.assign_batches(hours, 4)
    sizes = sorted(r["count"] for r in batched.groupBy("batch_id").count().collect())
    assert sizes == [1, 4, 4, 4, 4, 4, 4]
    assert cand.assign_batches(hours, 4, drop_last=True).count() == 24
    sets = cand.candidate_sets(batched, likes, posts_table(spark, []))
    assert sets.groupBy("batch_id").count().agg(F.max("count")).first()[0] == 4
    with pytest.raises(ValueError):
        cand.assign_batches(hours, 0)


def test_shuffle_changes_with_the_epoch(spark):
    hours = cand.user_hours(likes_table(spark, [(f"u{i}", f"p{i}", 10, "train", 1) for i in range(30)]))

    def batches(**options):
        return frozenset((r.did, r.batch_id) for r in cand.assign_batches(hours, 4, **options).collect())

    assert batches(epoch=1) == batches(epoch=1) != batches(epoch=2)
    assert batches(shuffle=False, epoch=1) == batches(shuffle=False, epoch=2)


def test_extra_negatives_never_drop_likes(spark):
    batched = cand.assign_batches(cand.user_hours(likes_table(spark, LIKES)), 10)
    posts = posts_table(spark, [(f"n{i}", 10, "train", True) for i in range(30)])

    def draw(epoch):
        sets = cand.candidate_sets(batched, likes_table(spark, LIKES), posts, 5, epoch=epoch).where("hour(like_hour_bucket) = 10").collect()
        assert {r.post_id for r in sets if r.from_likes} == {"p1", "p2", "p3"}
        return frozenset(r.post_id for r in sets if not r.from_likes)

    assert len(draw(0)) == 5 and draw(0) == draw(0) and draw(0) != draw(1)


def test_liked_lists(spark):
    row = cand.liked_lists(likes_table(spark, LIKES)).where("did = 'u1'").first()
    assert row.liked_post_ids == ["p1", "p2"] and row.liked_post_author_indices == [4, 1]


def test_a_hot_user_hour_is_labelled_whole(spark):
    """50,000 likes of one user in one hour, some of them twice, beside users with one each."""
    hot = spark.range(50_000).select(F.lit("hot").alias("did"), F.concat(F.lit("p"), F.col("id")).alias("subject_uri"))
    repeated = hot.where("subject_uri LIKE '%7'")
    others = spark.range(3).select(F.concat(F.lit("u"), F.col("id")).alias("did"), F.lit("p5").alias("subject_uri"))
    hour = F.lit("2024-01-01 10:00:00").cast("timestamp")
    likes = hot.unionByName(repeated).unionByName(others).withColumns(
        {
            "like_hour_bucket": hour, "record_created_at": hour, "split": F.lit("train"), "emb_idx": F.xxhash64("subject_uri"),
            "author_idx": F.lit(None).cast("long"), "prior_cumulative_likes": F.lit(None).cast("long"),
        }
    ).repartition(8)
    batched = cand.assign_batches(cand.user_hours(likes), 8)
    sets = cand.candidate_sets(batched, likes, posts_table(spark, [("n1", 10, "train", True)]))
    assert sets.agg(F.max(F.size("likers"))).first()[0] == 4
    labels = cand.labelled_pairs(batched, sets).groupBy("did").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    assert {r.did: (r.n, r.p) for r in labels} == {"hot": (50_001, 50_000), **{f"u{i}": (50_001, 1) for i in range(3)}}
    assert cand.liked_lists(likes).where("did = 'hot'").select(F.size("liked_post_ids")).first()[0] == 55_000


def scores(spark, matrix, labels):
    rows = [(f"u{i}", f"c{j}", float(s), int(labels[i][j])) for i, line in enumerate(matrix) for j, s in enumerate(line)]
    return spark.createDataFrame(rows, "did string, post_id string, score double, label int")


def ranked_labels(spark, labels):
    """Labels already in rank order."""
    return scores(spark, [[-j for j in range(len(line))] for line in labels], labels)


def test_rank_metrics(spark):
    df = ranked_labels(spark, [[1, 1, 0], [0, 1, 0]])
    m = ranking.rank_metrics(ranking.ranking_rows(df, ["did"], [1, 2]), [], [1, 2]).first()
    assert m.dcg_at_1 == pytest.approx(0.5) and m.recall_at_1 == pytest.approx(0.25)
    assert m.ndcg_at_2 == pytest.approx((1 + 1 / math.log2(3)) / 2)
    assert m.mean_average_precision == pytest.approx(0.75) and m.rank_metric_user_count == 2


def test_random_baseline(spark):
    df = ranked_labels(spark, [[1, 0, 1, 0], [0, 1, 0, 0]])
    m = ranking.random_baseline(ranking.ranking_rows(df, ["did"], [1, 3]), [], [1, 3]).first()
    assert m.recall_at_1 == pytest.approx(0.25) and m.recall_at_3 == pytest.approx(0.75)
    assert m.dcg_at_1 == pytest.approx((0.5 + 0.25) / 2)
    orders = []
    for labels in ([1, 0, 1, 0], [0, 1, 0, 0]):
        import itertools

        aps = []
        for perm in itertools.permutations(labels):
            hits, total = 0, 0.0
            for i, x in enumerate(perm, 1):
                if x:
                    hits += 1
                    total += hits / i
            aps.append(total / hits)
        orders.append(np.mean(aps))
    assert m.mean_average_precision == pytest.approx(np.mean(orders))


def test_strict_and_pooled_average_precision(spark):
    df = scores(spark, [[0.2, 0.1], [0.7, 0.8]], [[1, 0], [0, 1]])
    rows = ranking.ranking_rows(df, ["did"], [1])
    assert ranking.rank_metrics(rows, [], [1]).first().mean_average_precision == pytest.approx(1.0)
    assert ranking.threshold_metrics(df).first().average_precision == pytest.approx(5 / 6)


def test_ranking_rows(spark):
    df = scores(spark, [[0.9, 0.1, 0.8], [0.2, 0.7, 0.1], [0.3, 0.2, 0.1]], [[1, 0, 1], [0, 0, 1], [0, 0, 0]])
    rows = {r.did: r for r in ranking.ranking_rows(df, ["did"], [1]).collect()}
    assert (rows["u0"].positive_rank_min, rows["u0"].positive_rank_mean, rows["u0"].auc_roc) == (1.0, 1.5, 1.0)
    assert (rows["u1"].positive_rank_min, rows["u1"].auc_roc, rows["u1"].ndcg_at_1) == (3.0, 0.0, 0.0)
    none = rows["u2"]
    assert none.positive_count == 0 and none.recall_at_1 == 0.0 and none.auc_roc is None and none.average_precision is None


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_ap(y, s):
    total, recall = 0.0, 0.0
    for value in sorted(set(s), reverse=True):
        said = s >= value
        r = y[said].sum() / y.sum()
        total += (r - recall) * y[said].mean()
        recall = r
    return total


def test_threshold_metrics_with_ties_and_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"u{i % 5}", rng.choice([0.0, 0.5, rng.random()]), int(rng.random() < 0.3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "did string, score double, label int")
    got = {r.did: r for r in ranking.threshold_metrics(df, ["did"]).collect()}
    for user in got:
        y = np.array([l for u, _, l in rows if u == user])
        s = np.array([x for u, x, _ in rows if u == user])
        assert got[user].auc_roc == pytest.approx(brute_auc(y, s))
        assert got[user].average_precision == pytest.approx(brute_ap(y, s))
    y, s = np.array([l for _, _, l in rows]), np.array([x for _, x, _ in rows])
    whole = ranking.threshold_metrics(df).first()
    assert whole.auc_roc == pytest.approx(brute_auc(y, s)) and whole.pair_count == 3000


def test_threshold_metrics_with_a_null_group(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b"]), rng.random(), int(rng.random() < 0.4)) for _ in range(2500)]
    df = spark.createDataFrame(rows, "did string, score double, label int")
    got = {r.did: r.auc_roc for r in ranking.threshold_metrics(df.where("did is not null"), ["did"]).collect()}
    mixed = {r.did: r.auc_roc for r in ranking.threshold_metrics(df, ["did"]).collect() if r.did is not None}
    assert mixed == pytest.approx(got) and set(got) == {"a", "b"}


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("u", 0.3, 1), ("u", 0.4, 1)], "did string, score double, label int")
    row = ranking.threshold_metrics(df, ["did"]).first()
    assert row.auc_roc is None and row.average_precision == 1.0


def test_pooled_classification_sample(spark):
    rows = [(i, float(i % 17), int(i % 4 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, score double, label int")
    some = ranking.pooled_classification(df, ["id"], 500).first()
    assert some.classification_metric_sampled and some.classification_metric_sampled_pair_count == 500
    assert some.classification_metric_pair_count == 2000 and some.classification_metric_positive_count == 500
    everything = ranking.pooled_classification(df, ["id"], None).first()
    assert not everything.classification_metric_sampled


def test_zero_history_metrics(spark):
    df = ranked_labels(spark, [[1, 0], [0, 1]]).withColumn("num_embedding_likes", F.when(F.col("did") == "u1", 0).otherwise(4))
    rows = ranking.ranking_rows(df, ["did"], [1], extra=("num_embedding_likes",))
    m = ranking.zero_history_metrics(rows, [], [1]).first()
    assert m.zero_history_recall_at_1 == 0.0 and m.zero_history_rank_metric_user_count == 1


def test_listwise_loss(spark):
    matrix, labels = [[0.5, -1.0, 2.0], [1.0, 1.0, 0.0]], [[1, 0, 1], [0, 1, 0]]
    want = 0.0
    for s, y in zip(np.array(matrix), np.array(labels)):
        want += -(y / y.sum() * (s - np.log(np.exp(s).sum()))).sum()
    assert ranking.listwise_loss(scores(spark, matrix, labels), ["did"]).first().loss == pytest.approx(want / 2)
    with pytest.raises(Exception, match="without a positive"):
        ranking.listwise_loss(scores(spark, [[1.0]], [[0]]), ["did"]).collect()


def test_compare_models_long_table(spark):
    base = scores(spark, [[0.2, 0.1], [0.7, 0.8]], [[1, 0], [0, 1]]).withColumns(
        {"split": F.lit("val"), "bad": -F.col("score")}
    )
    models = {"good": ("dot", "score"), "bad": ("dot", "bad")}
    first = sorted({r.did for r in base.select("did").collect()})[0]
    base = base.withColumn("num_embedding_likes", F.when(F.col("did") == first, 0).otherwise(3))
    compared = comparison.compare_models(base, models, ["did", "split"], [1])
    table = {(r.model_name, r.metric): r.value for r in compared.collect()}
    assert {m for _, m in table} == set(comparison.comparison_metrics([1]))
    assert table[("good", "recall_at_1")] == 1.0 and table[("bad", "recall_at_1")] == 0.0
    assert table[("good", "classification_average_precision")] == pytest.approx(5 / 6)
    assert table[("good", "classification_metric_pair_count")] == 4.0
    assert table[("good", "classification_metric_sampled")] == 0.0
    assert table[("good", "zero_history_rank_metric_user_count")] == 1.0 and table[("good", "zero_history_recall_at_1")] == 1.0
    loss = sum(math.log(1 + math.exp(-0.1)) for _ in range(2)) / 2
    assert table[("good", "loss")] == pytest.approx(loss) and table[("bad", "loss")] == pytest.approx(loss + 0.1)
    drawn = comparison.compare_models(base, models, ["did", "split"], [1], max_pairs=3)
    table = {(r.model_name, r.metric): r.value for r in drawn.collect()}
    assert table[("good", "classification_metric_sampled_pair_count")] == 3.0
    assert table[("good", "classification_metric_sampled")] == 1.0 and table[("good", "classification_metric_pair_count")] == 4.0


def test_models_without_zero_history(spark):
    base = scores(spark, [[0.2, 0.1]], [[1, 0]]).withColumns({"split": F.lit("val"), "num_embedding_likes": F.lit(2)})
    compared = comparison.compare_models(base, {"m": ("dot", "score")}, ["did", "split"], [1])
    table = {r.metric: r.value for r in compared.collect()}
    assert table["zero_history_rank_metric_user_count"] == 0.0 and table["zero_history_ndcg_at_1"] == 0.0


ROWS = [
    ("u1", "val", 0, 3, 4, 1, 0.5, 0.5, 0.4, None),
    ("u1", "val", 3, 5, 4, 2, 1.0, 1.0, 0.9, 0.8),
    ("u2", "val", 1, 1, 2, 1, 0.0, 0.0, 0.5, 0.6),
]
ROW_SCHEMA = (
    "did string, split string, num_embedding_likes int, num_total_likes int, candidate_count int, positive_count int,"
    " ndcg_at_1 double, recall_at_1 double, average_precision double, auc_roc double"
)
METRICS = ["ndcg_at_1", "recall_at_1", "average_precision", "auc_roc"]


def test_user_metadata_and_binned_rows(spark):
    rows = spark.createDataFrame(ROWS, ROW_SCHEMA)
    assert {r.did: (r.num_embedding_likes, r.num_total_likes) for r in evaluation.user_metadata(rows).collect()} == {
        "u1": (3, 5), "u2": (1, 1),
    }
    binned = {r.bin: r for r in evaluation.binned_ranking(rows, METRICS).collect()}
    assert set(binned) == {"0", "1", "3"} and binned["0"].auc_roc is None and binned["0"].auc_roc_n == 0
    summary = {r.metric: r for r in evaluation.curve_summary(evaluation.binned_ranking(rows, METRICS), METRICS, False).collect()}
    assert summary["ndcg_at_1"].max_bin == "3" and summary["ndcg_at_1"].improvement_first_to_last == 0.5
    stats = evaluation.history_stats(rows).first()
    assert (stats.total_rows, stats.total_users, stats.median_history) == (3, 2, 1.0)
    assert stats.std_history == pytest.approx(np.std([0, 3, 1], ddof=1))


def brute_gini(x):
    x = np.sort(x)
    n = len(x)
    return 2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n


def test_gini_and_lorenz(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(4000) < 0.3, 0.0, rng.random(4000).round(2))
    df = spark.createDataFrame([(f"u{i}", "m", float(v)) for i, v in enumerate(x)], "did string, metric string, value double")
    assert inequality.gini(df).first().gini == pytest.approx(brute_gini(x))
    curve = inequality.lorenz(df).toPandas().sort_values("position")
    assert len(curve) == 4001 and curve["value_share"].iloc[0] == 0.0
    assert np.allclose(curve["value_share"].iloc[1:], np.cumsum(np.sort(x)) / x.sum())
    assert np.allclose(curve["population_share"], np.arange(4001) / 4000)
    summary = inequality.inequality_summary(df).first()
    assert summary["std"] == pytest.approx(x.std()) and summary["median"] == pytest.approx(np.median(x))


def test_gini_edges(spark):
    zeros = spark.createDataFrame([("a", "m", 0.0), ("b", "m", 0.0)], "did string, metric string, value double")
    assert inequality.gini(zeros).first().gini == 0.0
    wide = spark.createDataFrame([("a", 1.0, None), ("b", float("nan"), None)], "did string, x double, y double")
    assert [tuple(r) for r in inequality.long_metrics(wide, ["x", "y"]).collect()] == [("a", "x", 1.0)]


PREDICTIONS = "did string, post_id string, y_true int, y_pred_proba double, num_embedding_likes int"


def test_classification(spark):
    df = spark.createDataFrame(
        [("a", "1", 1, 0.9, 0), ("a", "2", 0, 0.8, 0), ("a", "3", 1, 0.5, 1), ("b", "4", 0, 0.1, 12)], PREDICTIONS
    )
    row = evaluation.classification_metrics(df).first()
    assert (row.precision, row.recall, row.f1) == (0.5, 0.5, 0.5)
    users = {r.did: r for r in evaluation.per_user_classification(df).collect()}
    assert users["a"].auc_roc == 0.5 and users["a"].accuracy == pytest.approx(1 / 3)
    assert users["b"].precision == 0.0 and users["b"].recall == 0.0 and users["b"].auc_roc is None
    bins = {r.bin: r for r in evaluation.binned_predictions(df).collect()}
    assert set(bins) == {"0", "1", "10-19"} and bins["0"].recall == 1.0
    health = evaluation.prediction_health(df).first()
    assert (health.n_zero_history, health.n_odd_bins, health.max_history_lengths) == (2, 2, 2)


def test_popularity_log_stats_defaults(spark):
    history = spark.createDataFrame([], "prior_cumulative_likes array<bigint>")
    likes = likes_table(spark, [])
    negatives = cand.sampled_posts(posts_table(spark, []))
    assert tuple(evaluation.popularity_log_stats(history, likes, negatives).first()) == (0.0, 1.0, 0)
    same = spark.createDataFrame([([3, 3],)], "prior_cumulative_likes array<bigint>")
    row = evaluation.popularity_log_stats(same, likes, negatives).first()
    assert row.log_mean == pytest.approx(math.log(4)) and row.log_std == 1.0


def test_pairs_dataset(spark):
    likes = spark.createDataFrame([("u1", "p1"), ("u1", "p2"), ("u2", "p1")], "did string, subject_uri string")
    posts = spark.createDataFrame([("p1", 0.1), ("p2", 0.2), ("p3", 0.3)], "at_uri string, f double")
    rows = pairs.pairs_dataset(likes, posts).collect()
    liked = {(r.did, r.at_uri) for r in rows if r.liked == 1}
    negative = {(r.did, r.at_uri) for r in rows if r.liked == 0}
    assert len(liked) == 3 and len(negative) == 2 and not liked & negative


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 1000])
def test_places_are_a_permutation(spark, n):
    df = spark.range(n).select("id", pairs.shuffled_place(F.col("id"), F.lit(n).cast("long"), F.lit("u")).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_places_beyond_32_bits(spark):
    n = 5 * 10**12
    df = spark.range(2000).select(pairs.shuffled_place(F.col("id"), F.lit(n), F.lit("u")).alias("p"))
    got = [r.p for r in df.collect()]
    assert len(set(got)) == 2000 and all(0 <= p < n for p in got)
    assert max(got) > 2**32 and 0.4 < sum(got) / 2000 / n < 0.6


def test_users_draw_on_their_own(spark):
    """Two users with 100 draws of 1,000 share about 10, whatever their names."""
    users = spark.createDataFrame([(f"u{i}",) for i in range(60)], "did string").crossJoin(spark.range(100))
    place = pairs.shuffled_place(F.col("id"), F.lit(1000).cast("long"), "did")
    drawn = {}
    for r in users.select("did", place.alias("p")).collect():
        drawn.setdefault(r.did, set()).add(r.p)
    sets = list(drawn.values())
    shared = [len(a & b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 9.5 < sum(shared) / len(shared) < 10.5 and max(shared) < 30


def test_negative_pairs_of_a_hot_user(spark):
    rng = random.Random(8)
    rows = [("hot", f"p{i:04d}") for i in range(600)] + [
        (f"u{rng.randrange(80)}", f"p{rng.randrange(1000):04d}") for _ in range(1200)
    ]
    likes = spark.createDataFrame(rows, "did string, subject_uri string")
    posts = spark.createDataFrame([(f"p{i:04d}",) for i in range(1000)], "at_uri string")
    liked = {}
    for u, p in rows:
        liked.setdefault(u, set()).add(p)
    got = {}
    for r in pairs.negative_pairs(likes, posts).collect():
        assert r.at_uri not in got.setdefault(r.did, set())
        got[r.did].add(r.at_uri)
    assert {u: len(p) for u, p in got.items()} == {u: min(len(p), 1000 - len(p)) for u, p in liked.items()}
    assert not any(got[u] & liked[u] for u in got)


def test_floor_and_rerank(spark):
    scored = spark.createDataFrame(
        [("m", f"p{i}", "a", s) for i, s in enumerate((0.9, 0.8, 0.7, 0.6), 1)],
        "model_run_id string, at_uri string, author_did string, score double",
    )
    counts = spark.createDataFrame([("p1", 4), ("p2", 5), ("p3", 20)], "at_uri string, like_count int")
    top = retrieval.top_k_with_floor(scored, counts, 2, 5).sort("rank").collect()
    assert [(r.at_uri, r["rank"]) for r in top] == [("p2", 1), ("p3", 2)]
    free = retrieval.top_k_with_floor(scored, counts, 3, None).sort("rank").collect()
    assert [r.at_uri for r in free] == ["p1", "p2", "p3"]
    for bad in ((0, None), (2, -1)):
        with pytest.raises(ValueError):
            retrieval.top_k_with_floor(scored, counts, *bad)


def test_the_floor_goes_before_the_cut(spark):
    rows = [("m", f"p{i:04d}", "a", 1.0 - i / 1000) for i in range(500)]
    scored = spark.createDataFrame(rows, "model_run_id string, at_uri string, author_did string, score double")
    counts = spark.createDataFrame([(f"p{i:04d}", i) for i in range(500)], "at_uri string, like_count int")
    top = retrieval.top_k_with_floor(scored, counts, 3, 400).sort("rank").collect()
    assert [r.at_uri for r in top] == ["p0400", "p0401", "p0402"]


def test_top_k_and_author_order(spark):
    scored = spark.createDataFrame(
        [("m", f"p{i}", a, s) for i, (a, s) in enumerate([("x", 0.5), ("y", 0.1), ("y", 0.8), ("x", 0.7)], 1)],
        "model_run_id string, at_uri string, author_did string, score double",
    )
    top = retrieval.top_k(scored, 2)
    assert [r.at_uri for r in top.sort("rank").collect()] == ["p3", "p4"]
    assert [r.at_uri for r in retrieval.global_top_k(scored, 2).collect()] == ["p3", "p4"]
    authors = retrieval.sorted_authors(retrieval.author_concentration(retrieval.top_k(scored, 3))).collect()
    assert [(r.author_did, r["count"], r.best_rank) for r in authors] == [("x", 2, 2), ("y", 1, 1)]


def test_user_vector_and_scores(spark):
    history = spark.createDataFrame(
        [(1, [1.0, 0.0], True), (2, [0.0, 1.0], True), (3, None, False)],
        "rank int, embedding array<float>, embedding_present boolean",
    )
    posts = spark.createDataFrame(
        [("p1", "a", HOUR, [2.0, 0.0]), ("p2", "b", HOUR, [0.0, 4.0]), ("p3", "b", HOUR, [1.0])],
        "at_uri string, author_did string, record_created_at timestamp, embedding array<float>",
    )
    users = {"mean": retrieval.user_vector(history, 2), "unit": retrieval.user_vector(history, 2, normalise=True)}
    got = {(r.model_run_id, r.at_uri): r.score for r in retrieval.score_posts(posts, users, 2).collect()}
    assert got[("mean", "p2")] == 2.0 and len(got) == 4
    assert got[("unit", "p1")] == pytest.approx(2 / math.sqrt(2))


def test_prior_like_sample_is_strictly_earlier(spark):
    rng = random.Random(1)
    rows = [(f"u{i % 7}", f"p{i}", rng.randrange(0, 20), "train", 1) for i in range(200)]
    likes = likes_table(spark, rows)
    got = retrieval.sampled_prior_likes(likes, 60, 4).collect()
    assert len(got) == 60
    by_user = {}
    for u, p, h, _, _ in rows:
        by_user.setdefault(u, []).append((h, int(p[1:])))
    for r in got:
        earlier = sorted([x for x in by_user[r.did] if x[0] < r.target_ts.hour], reverse=True)
        assert r.prior_emb_indices == [e for _, e in earlier[:4]]


def test_coverage(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 1, 5),), (datetime(2024, 1, 1, 1, 6),), (datetime(2024, 1, 3),)], "record_created_at timestamp")
    other = spark.createDataFrame([(datetime(2024, 1, 2),)], "record_created_at timestamp")
    hourly = coverage.sources_hourly({"a": df, "b": other})
    daily = {str(r.date): (r.a, r.b) for r in coverage.daily_comparison(hourly, ["a", "b"]).collect()}
    assert daily == {"2024-01-01": (2, 0), "2024-01-02": (0, 1), "2024-01-03": (1, 0)}
    assert coverage.hourly_counts(df, "absent").count() == 0
    density = coverage.file_density(df.withColumnRenamed("record_created_at", "stamp")).first()
    assert (density.total_files, density.expected_days, density.missing_days, density.mean_files_per_day) == (3, 3, 1, 1.5)
    assert coverage.file_density(df.limit(0).withColumnRenamed("record_created_at", "stamp")).first().expected_days == 0
    compared = {r.source: r for r in coverage.compare_sources({"a": df, "b": other}).collect()}
    assert not compared["a"].has_embeddings and compared["a"].total_records == 3


def test_profile_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "a")], "x int, y string")
    rows = {r.column: (r.dtype, r.n_unique, r.n_null) for r in profile.column_profile(df).collect()}
    assert rows == {"x": ("int", 2, 0), "y": ("string", 2, 1)}
    assert [tuple(r) for r in profile.top_values(df, "y").collect()] == [("a", 2), (None, 1)]


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 50], [1, 1, 2, 2, 3, 400, 7], [5, 5, 5]])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "like_count long")
    x = np.array(values)
    skewed = x.max() > 10 * np.median(x)
    edges = np.logspace(0, np.log10(x.max() + 1), 50) if skewed else 50
    counts, _ = np.histogram(x, bins=edges)
    got = {r.bin: r.n_users for r in profile.likes_histogram(df).collect()}
    assert got == {i: c for i, c in enumerate(counts) if c}
