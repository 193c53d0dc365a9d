"""Core tables: likes, posts, popularity, authors, embeddings, history."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions.codec import encode_vector
from tidemark.functions.hashing import seeded_hash
from tidemark.functions.splits import Windows
from tidemark.operators import authors, cohorts, flow, history, likes as likes_ops, popularity, posts as posts_ops
from tidemark.plans import durable
from tidemark.plans.topn import top_n_per_group
from tidemark.sources import embeddings as emb

LIKES = "did string, subject_uri string, record_created_at string"


def ts(text):
    return datetime.fromisoformat(text)


def likes_frame(spark, rows):
    return spark.createDataFrame(rows, LIKES).withColumn(N.TS, F.col(N.TS).cast("timestamp"))


def test_window_min_likes_split_and_hour(spark):
    raw = likes_frame(
        spark,
        [
            ("user_a", "post:1", "2024-01-02T00:00:00"),
            ("user_a", "post:2", "2024-01-03T00:00:00"),
            ("user_b", "post:3", "2024-01-02T00:00:00"),
            ("user_c", "post:4", "2024-01-05T00:00:00"),
        ],
    ).where("record_created_at >= '2024-01-02' and record_created_at < '2024-01-04'")
    windows = Windows("2024-01-01", "2024-01-03")
    sampled = cohorts.sample_cohorts(raw, 2, None, None)
    rows = likes_ops.likes_core(raw, sampled, windows).sort(N.ITEM).collect()
    assert [(r.did, r.subject_uri, r.split) for r in rows] == [
        ("user_a", "post:1", "train"),
        ("user_a", "post:2", "val"),
    ]
    assert rows[0][N.HOUR] == ts("2024-01-02")


def test_random_cap_and_its_seed(spark):
    raw = likes_frame(
        spark, [("user_a", f"post:{i}", "2024-01-02T00:00:00") for i in range(5)] + [("user_b", "post:9", "2024-01-02")]
    )
    first = {(r.did, r.subject_uri) for r in likes_ops.random_cap(raw, 2).collect()}
    assert sorted(u for u, _ in first) == ["user_a", "user_a", "user_b"]
    assert first == {(r.did, r.subject_uri) for r in likes_ops.random_cap(raw, 2).collect()}
    assert likes_ops.random_cap(raw, 0).count() == 6
    other = [
        frozenset((r.did, r.subject_uri) for r in likes_ops.random_cap(raw, 2, seed=s).collect()) for s in range(8)
    ]
    assert len(set(other)) > 1


def test_salted_cap_keeps_the_same_likes(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"u{rng.randrange(50)}", f"p{i % 700}", f"2024-01-02T00:{i % 60:02d}:00") for i in range(3000)]
    raw = likes_frame(spark, rows)
    keyed = raw.withColumn("_rand", seeded_hash(N.SEED, "cap", N.USER, N.ITEM))
    plain = top_n_per_group(keyed, [N.USER], ["_rand", N.ITEM, N.TS], 20).drop("_rand")
    salted = likes_ops.random_cap(raw, 20)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_recency_cap(spark):
    raw = likes_frame(spark, [("u", f"p{i}", f"2024-01-0{i}T00:00:00") for i in range(1, 6)])
    assert {r.subject_uri for r in likes_ops.recency_cap(raw, 2).collect()} == {"p5", "p4"}


def test_repeated_likes_use_up_the_cap(spark):
    raw = likes_frame(spark, [("u", "p1", f"2024-01-02T00:0{i}:00") for i in range(3)])
    assert likes_ops.random_cap(raw, 2).count() == 2


def ten_users(spark):
    return likes_frame(
        spark, [(f"u{i}", f"p{j}", "2024-01-02T00:00:00") for i in range(10) for j in range(2)]
    )


def test_cohorts_are_disjoint_and_reproducible(spark):
    def draw(seed):
        rows = cohorts.sample_cohorts(ten_users(spark), 2, 5, 3, seed).collect()
        return {c: frozenset(r.did for r in rows if r["_user_cohort"] == c) for c in ("trainval", "unseen_eval")}

    a = draw(42)
    assert len(a["trainval"]) == 5 and len(a["unseen_eval"]) == 3
    assert not a["trainval"] & a["unseen_eval"]
    assert a == draw(42)
    assert len({draw(s)["trainval"] for s in range(6)}) > 1


def test_cohort_limits(spark):
    raw = ten_users(spark)
    assert cohorts.sample_cohorts(raw, 2, None, None).where("_user_cohort = 'unseen_eval'").count() == 0
    assert cohorts.sample_cohorts(raw, 2, 0, 4).count() == 4
    assert cohorts.sample_cohorts(raw, 3, 5, 5).count() == 0
    assert cohorts.cohort_size_bound(5, 3) == 8 and cohorts.cohort_size_bound(None, 3) is None


def test_five_split_names(spark):
    days = ["2024-01-02", "2024-01-04", "2024-01-06"]
    raw = likes_frame(spark, [(f"u{i}", f"p{i}{d}", f"{d}T10:00:00") for i in range(8) for d in days])
    windows = Windows("2024-01-01", "2024-01-03", "2024-01-05", "2024-01-07")
    sampled = cohorts.sample_cohorts(raw, 2, 3, 2)
    core = likes_ops.likes_core(raw, sampled, windows, max_users=5)
    assert {r.split: r["count"] for r in core.groupBy("split").count().collect()} == {
        "train": 3,
        "val": 3,
        "holdout_seen_users": 3,
        "val_unseen_users": 2,
        "holdout_unseen_users": 2,
    }


def test_null_split_fails(spark):
    df = spark.createDataFrame([("u", None)], "did string, split string")
    with pytest.raises(Exception, match="null split"):
        likes_ops.split_or_error(df).collect()


FORCED = [
    ("u1", "post:forced", "2024-01-02T00:10:00"),
    ("u2", "post:forced", "2024-01-02T00:20:00"),
    ("u3", "post:forced", "2024-01-02T01:05:00"),
]


def test_prior_popularity_is_strictly_before_the_hour(spark):
    needed = spark.createDataFrame(
        [("post:forced", ts(f"2024-01-02T0{h}:00:00")) for h in range(3)] + [("post:none", ts("2024-01-02T00:00:00"))],
        "subject_uri string, target_hour timestamp",
    )
    prior = popularity.prior_popularity(popularity.hourly_likes(likes_frame(spark, FORCED)), needed)
    got = {(r.subject_uri, r.target_hour.hour): r[N.PRIOR] for r in prior.collect()}
    assert got == {("post:forced", 0): 0, ("post:forced", 1): 2, ("post:forced", 2): 3, ("post:none", 0): 0}


def test_popularity_curve(spark):
    raw = likes_frame(spark, FORCED + [("u1", "post:other", "2024-01-02T02:15:00")])
    ids = spark.createDataFrame([("post:forced", 10), ("post:other", 20)], "subject_uri string, emb_idx int")
    curve = popularity.popularity_curve(popularity.hourly_likes(raw), ids)
    assert {(r.emb_idx, r.popularity_hour_bucket.hour): r[N.PRIOR] for r in curve.collect()} == {
        (10, 1): 2,
        (10, 2): 3,
        (20, 3): 1,
    }


def test_candidate_counts(spark):
    rows = [("u1", "forced"), ("u2", "forced"), ("u1", "sampled"), ("u2", "sampled"), ("u1", "low")]
    raw = likes_frame(spark, [(u, p, "2024-01-02T00:00:00") for u, p in rows])
    assert popularity.candidate_counts(raw, 0.0, 2).count() == 0
    assert {r.subject_uri for r in popularity.candidate_counts(raw, 1.0, 2).collect()} == {"forced", "sampled"}
    stats = popularity.candidate_stats(popularity.sampled_like_counts(raw, 1.0), 2).first()
    assert tuple(stats) == (3, 5, 2, 4)


POSTS = "at_uri string, record_created_at timestamp, did string, record_text string"


def test_the_popular_post_wins_every_hour(spark):
    posts = spark.createDataFrame(
        [(p, ts("2024-01-01T12:00:00"), "a", p) for p in ("mid", "popular")], POSTS
    )
    counts = spark.createDataFrame([("mid", 6), ("popular", 1_000_000)], "subject_uri string, global_like_count long")
    liked = spark.createDataFrame([("mid",)], "subject_uri string")
    rows = posts_ops.hourly_negatives(
        posts, counts, liked, Windows("2024-01-01", "2024-01-05"), per_hour=1, alpha=1.0
    ).sort(N.NEG_HOUR).collect()
    assert [r.at_uri for r in rows] == ["popular"] * 24
    assert rows[0][N.NEG_HOUR] == ts("2024-01-01T12:00:00") and rows[-1][N.NEG_HOUR] == ts("2024-01-02T11:00:00")
    assert not any(r.is_liked for r in rows) and all(r.in_random_sample for r in rows)


def test_hours_draw_differently_and_bounds_hold(spark):
    posts = spark.createDataFrame([(f"p{i}", ts("2024-01-01T12:30:00"), "a", "t") for i in range(40)], POSTS)
    counts = spark.createDataFrame([(f"p{i}", 5) for i in range(40)], "subject_uri string, global_like_count long")
    liked = spark.createDataFrame([], "subject_uri string")
    windows = Windows("2024-01-01T14:00:00", "2024-01-01T18:00:00", "2024-01-01T20:00:00", "2024-01-01T23:00:00")
    rows = posts_ops.hourly_negatives(posts, counts, liked, windows, 3, posts_end="2024-01-01T22:00:00").collect()
    by_hour = {}
    for r in rows:
        by_hour.setdefault(r[N.NEG_HOUR].hour, set()).add(r.at_uri)
    assert sorted(by_hour) == list(range(14, 22))
    assert all(len(v) == 3 for v in by_hour.values()) and len({frozenset(v) for v in by_hour.values()}) > 1


def test_liked_posts_are_always_in(spark):
    posts = spark.createDataFrame(
        [("p1", ts("2024-01-02T00:00:00"), "a", "t"), ("p2", ts("2024-01-04T00:00:00"), "b", "t"),
         ("p2", ts("2024-01-03T00:00:00"), "b", "t")], POSTS,
    )
    counts = spark.createDataFrame([("p1", 5)], "subject_uri string, global_like_count long")
    likes = spark.createDataFrame([("p2",), ("gone",)], "subject_uri string")
    core = posts_ops.posts_core(posts, counts, likes, Windows("2024-01-01", "2024-01-04"), per_hour=1)
    liked = core.where("is_liked").collect()
    assert [(r.at_uri, r.in_random_sample, r[N.NEG_HOUR], r.split_window) for r in liked] == [
        ("p2", False, None, "train")
    ]
    assert core.where("in_random_sample").count() == 24


def test_author_index(spark):
    posts = spark.createDataFrame(
        [("p1", "author_a", True, "train"), ("p2", "author_a", True, "train"), ("p3", "author_b", True, "train"),
         ("p4", "author_a", True, "val"), ("p5", "author_a", False, "train"), ("p6", None, True, "train")],
        "at_uri string, did string, in_random_sample boolean, split_window string",
    )
    likes = spark.createDataFrame(
        [("u", "p1", "train", "author_a")] * 3 + [("u", "p3", "val", "author_b")],
        "did string, subject_uri string, split string, author_did string",
    )
    index = authors.author_index(posts, likes, 2)
    assert [tuple(r) for r in index.collect()] == [("author_a", 5, 2)]
    joined = authors.with_author_idx(posts, index, N.USER)
    assert {(r.did, r.author_idx) for r in joined.collect()} == {("author_a", 2), ("author_b", None), (None, None)}
    stats = authors.author_stats(posts, likes, 2).first()
    assert stats.n_authors_indexed == 1 and stats.n_author_train_exposures == 7
    assert authors.author_table_size(index).first().n_author_rows == 3
    assert authors.author_table_size(index.limit(0)).first().n_author_rows == 2


def test_author_ids_follow_the_names(spark):
    posts = spark.createDataFrame(
        [(f"p{a}", a, True, "train") for a in "bac"],
        "at_uri string, did string, in_random_sample boolean, split_window string",
    )
    likes = spark.createDataFrame([], "did string, subject_uri string, split string, author_did string")
    assert {r.author_did: r.author_idx for r in authors.author_index(posts, likes, 1).collect()} == {"a": 2, "b": 3, "c": 4}


def test_dense_ids_of_many_keys(spark):
    keys = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k"))
    ids = emb.dense_ids(keys.unionByName(keys), "k", "n", 7).sort("k").collect()
    assert [r.n for r in ids] == list(range(7, 5007))


def raw_posts(spark):
    rows = [(f"post:{i}", ts("2024-01-02T00:00:00"), f"user_{i}", "t", [i + 0.1, i + 0.2, i + 0.3]) for i in range(1, 5)]
    rows += [("post:5", ts("2024-01-02T00:00:00"), "user_5", "t", None), ("post:6", ts("2024-01-02"), "u", "t", [1.0]),
             ("post:1", ts("2024-01-03T00:00:00"), "user_1", "t", [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, POSTS + ", v array<float>")
    return df.withColumn(
        "embeddings",
        F.when(F.col("v").isNotNull(), F.array(F.struct(F.lit("m").alias("key"), encode_vector("v").alias("value")))),
    ).drop("v")


def test_embedding_table(spark):
    raw = raw_posts(spark)
    candidates = raw.where("at_uri <> 'post:4'").select(N.POST)
    vectors = emb.candidate_vectors(raw, candidates, emb.raw_vector("m"))
    table = emb.embedding_table(vectors, 3).sort(N.EMB).collect()
    assert [(r.at_uri, r.emb_idx) for r in table] == [("post:1", 0), ("post:2", 1), ("post:3", 2)]
    assert table[0].embedding == pytest.approx([1.1, 1.2, 1.3])
    stats = emb.embedding_stats(vectors, candidates, 3).first()
    assert stats.n_embeddings_valid == 3 and stats.n_embeddings_null == 1
    assert stats.n_embeddings_wrong_dim == 1 and stats.n_embeddings_duplicate_uri == 1
    assert stats.n_posts_dropped_no_embedding == 2
    assert emb.first_dim(vectors.where("at_uri = 'post:2'")).first().dim == 3


def test_no_valid_embedding_is_an_error(spark):
    vectors = emb.candidate_vectors(raw_posts(spark), raw_posts(spark), emb.raw_vector("absent"))
    with pytest.raises(ValueError, match="no valid"):
        emb.require_embeddings(emb.embedding_table(vectors, 3))


HISTORY_LIKES = "did string, record_created_at timestamp, subject_uri string, emb_idx int, prior_cumulative_likes long, author_idx int"
CURVE = "emb_idx int, popularity_hour_bucket timestamp, prior_cumulative_likes long"


def run_history(spark, likes, curve=(), max_prior=None, with_authors=True):
    df = spark.createDataFrame([(u, ts(t), f"p{e}", e, 0, a) for u, t, e, a in likes], HISTORY_LIKES)
    df = df.withColumn(N.HOUR, F.date_trunc("hour", N.TS))
    curve = spark.createDataFrame([(e, ts(t), c) for e, t, c in curve], CURVE)
    return history.user_history(df, curve, max_prior, with_authors)


def test_history_starts_empty(spark):
    likes = [("u1", f"2024-01-01T{t}:00", e, 5) for t, e in (("10:15", 100), ("11:20", 200), ("12:05", 300))]
    rows = run_history(spark, likes).sort(N.HOUR).collect()
    assert [r.prior_emb_indices for r in rows] == [[], [100], [200, 100]]
    ages = [r.prior_like_age_hours_at_bucket_start for r in rows]
    assert ages[0] == [] and ages[1] == pytest.approx([0.75]) and ages[2] == pytest.approx([2 / 3, 1.75])
    assert [r.raw_prior_count for r in rows] == [0, 1, 2]


def test_history_cap_keeps_the_newest(spark):
    likes = [("u", f"2024-01-{d:02d}T00:00:00", e, None) for d, e in ((5, 10), (1, 20), (10, 30), (7, 40))]
    rows = run_history(spark, likes, max_prior=2).where("like_hour_bucket = '2024-01-10'").collect()
    assert rows[0].prior_emb_indices == [40, 10] and rows[0].raw_prior_count == 3
    assert rows[0].prior_like_age_hours_at_bucket_start == [72.0, 120.0]


def test_history_leaves_the_same_hour_out(spark):
    likes = [("u", f"2024-01-01T{t}:00", e, None) for t, e in (("10:05", 1), ("11:10", 2), ("11:50", 3))]
    row = run_history(spark, likes).where("hour(like_hour_bucket) = 11").first()
    assert row.prior_emb_indices == [1] and row.raw_prior_count == 1


def test_history_popularity_is_that_of_the_target_hour(spark):
    likes = [("u", "2024-01-01T10:05:00", 100, None), ("u", "2024-01-01T12:10:00", 200, None)]
    curve = [(100, "2024-01-01T11:00:00", 5), (100, "2024-01-01T12:00:00", 99), (100, "2024-01-01T13:00:00", 500)]
    assert run_history(spark, likes, curve).where("hour(like_hour_bucket) = 12").first()[N.PRIOR] == [99]
    other = [(200, "2024-01-01T11:00:00", 5)]
    assert run_history(spark, likes, other).where("hour(like_hour_bucket) = 12").first()[N.PRIOR] == [0]


def test_history_authors(spark):
    likes = [("u", "2024-01-01T10:05:00", 1, 7), ("u", "2024-01-01T10:06:00", 2, None), ("u", "2024-01-01T12:00:00", 3, 4)]
    assert run_history(spark, likes).where("hour(like_hour_bucket) = 12").first().prior_author_indices == [None, 7]
    assert "prior_author_indices" not in run_history(spark, likes, with_authors=False).columns


def test_history_matches_brute_force_with_a_hot_user(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    likes = []
    for i in range(900):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(60)}"
        likes.append((user, (start + timedelta(seconds=rng.randrange(6 * 86400))).isoformat(), i, i % 5))
    got = {(r.did, r[N.HOUR]): (r.prior_emb_indices, r.raw_prior_count) for r in run_history(spark, likes, max_prior=6).collect()}
    want = {}
    for user, t, _, _ in likes:
        hour = ts(t).replace(minute=0, second=0)
        prior = sorted(((ts(x), e) for u, x, e, _ in likes if u == user and ts(x) < hour), reverse=True)
        want[(user, hour)] = ([e for _, e in prior[:6]], len(prior))
    assert got == want


def test_long_histories_draw_a_warning(spark, monkeypatch):
    monkeypatch.setattr(history, "LONG_LIST", 2)
    with pytest.warns(UserWarning, match="max_prior"):
        run_history(spark, [("u", f"2024-01-01T1{i}:00:00", i, None) for i in range(3)])


def test_history_distribution_and_summary(spark):
    likes = [("u", f"2024-01-01T1{i}:00:00", i, None) for i in range(5)] + [("v", "2024-01-01T10:00:00", 9, None)]
    table = run_history(spark, likes).cache()
    rows = {r.stage: r for r in history.history_distribution(table, 2).collect()}
    assert rows["before"]["max"] == 4 and rows["after"]["max"] == 2 and rows["before"]["median"] == 2.0
    assert rows["before"].n_users_capped == 1 and rows["before"].n_likes_dropped == 2
    summary = history.history_summary(table).first()
    assert (summary.n_rows, summary.n_with_history, summary.max_prior, summary.min_prior) == (6, 4, 4, 1)


def test_reverify_drops_users_below_the_minimum(spark):
    likes = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p1"), ("b", "gone")], "did string, subject_uri string")
    posts = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "at_uri string")
    assert {r.did for r in likes_ops.reverify(likes, posts, 2).collect()} == {"a"}
    assert likes_ops.reverify(likes, posts, 0).count() == 3


def test_flow_with_and_without_vectors(spark, tmp_path):
    raw = likes_frame(
        spark, [(u, f"post:{i}", f"2024-01-0{d}T10:00:00") for d, u in ((2, "a"), (3, "b")) for i in range(1, 5)]
    )
    posts = raw_posts(spark)
    run = flow.Settings(
        Windows("2024-01-01", "2024-01-03"), max_trainval=10, max_unseen=0, negative_share=1.0, min_negative_likes=1,
        negatives_per_hour=2, min_author_support=1, max_prior=5,
    )
    core = flow.core_tables(raw, posts, run, emb.raw_vector("m"), 3, str(tmp_path))
    assert core.embeddings.count() == 4 and core.likes.count() == 8
    assert core.likes.where("emb_idx is null or author_idx is null").count() == 0
    assert {p.name for p in tmp_path.iterdir()} == {
        "likes_core", "posts_core", "author_idx", "liked_post_hour_cumulative_likes", "embeddings",
    }
    assert spark.read.parquet(str(tmp_path / "likes_core")).count() == 8
    bare = flow.core_tables(raw, posts, run)
    assert bare.embeddings is None and bare.posts.where("emb_idx is null").count() == 0
    assert flow.history_table(core, run).count() == 2
    with pytest.raises(ValueError):
        flow.core_tables(raw, posts, run, emb.raw_vector("m"))


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = durable.ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert folder and (configured is None or configured.rstrip("/") in folder)


def test_hot_post_in_every_join(spark):
    """A third of all likes on one post, a third in one user's day: core joins and positions against brute force."""
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        user = "hot" if i % 3 == 1 else f"u{rng.randrange(40)}"
        post = "viral" if i % 3 == 0 else f"p{rng.randrange(60)}"
        hours = 0 if user == "hot" else rng.randrange(200)
        rows.append((user, post, datetime(2024, 1, 3) + timedelta(hours=hours, seconds=i)))
    likes = spark.createDataFrame(rows, "did string, subject_uri string, record_created_at timestamp").repartition(7)
    placed = {(r.did, r.subject_uri, r.record_created_at): r.like_order for r in likes_ops.like_positions(likes).collect()}
    by_user = {}
    for user, post, when in sorted(rows, key=lambda r: (r[2], r[1])):
        by_user.setdefault(user, []).append((user, post, when))
    assert placed == {r: k for found in by_user.values() for k, r in enumerate(found, 1)}

    hourly = likes.withColumn(N.HOUR, F.date_trunc("hour", N.TS))
    prior = hourly.groupBy(N.ITEM, F.col(N.HOUR).alias("target_hour")).agg(F.count("*").alias(N.PRIOR)).where("subject_uri != 'p1'")
    known = {(r[0], r[1]): r[2] for r in prior.collect()}
    got = popularity.with_prior_on_likes(hourly, prior).collect()
    assert len(got) == len(rows)
    assert all(r[N.PRIOR] == known.get((r[N.ITEM], r[N.HOUR]), 0) for r in got)
    posts = spark.createDataFrame([(p,) for p in {r[1] for r in rows} if p != "p2"], "at_uri string")
    kept = likes_ops.reverify(likes, posts, 0)
    assert kept.count() == sum(r[1] != "p2" for r in rows)


@pytest.mark.parametrize("max_prior", [1, 3, 40, 5000])
def test_prior_items_against_brute_force(spark, max_prior):
    """One user with a third of the likes, hours of more likes than the cap, ties in time."""
    rng = random.Random(max_prior)
    rows = []
    for i in range(1500):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(20)}"
        when = datetime(2024, 1, 3, rng.randrange(24), rng.choice([0, 0, rng.randrange(60)]))
        rows.append((user, when.replace(minute=0), when, rng.choice([None, i])))
    likes = spark.createDataFrame(rows, f"did string, {N.HOUR} timestamp, {N.TS} timestamp, {N.EMB} long").repartition(5)
    prior = history.prior_items(likes, max_prior)
    got = {(r.did, r[N.HOUR]): (r.raw_prior_count, [(e[N.TS], e[N.EMB]) for e in r.prior]) for r in prior.collect()}
    want = {}
    for user, hour in {(r[0], r[1]) for r in rows}:
        earlier = [(r[2], r[3]) for r in rows if r[0] == user and r[1] < hour]
        earlier.sort(key=lambda e: (e[0], e[1] is not None, e[1] or 0), reverse=True)
        want[(user, hour)] = (len(earlier), earlier[:max_prior])
    assert got == want
