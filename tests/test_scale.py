"""Plans that keep their cost in proportion to the rows: what is shuffled, and in how many parts."""

import re

from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions import vectors
from tidemark.operators import candidates as cand
from tidemark.operators.comparison import model_rows
from tidemark.operators.history import history_vectors
from tidemark.plans.spread import lookup_join
from tidemark.queries import scored
from tidemark.queries import tables as t

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_vectors_are_not_shuffled(spark):
    # So many posts that none is a hot key of its join.
    rows = [("u", k, [2 * k, 2 * k + 1, 0]) for k in range(1, 60)] + [("v", 1, []), ("w", 1, [999])]
    history = spark.createDataFrame(rows, f"{N.USER} string, {N.HOUR} int, prior_emb_indices array<long>")
    embeddings = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], f"{N.EMB} long, embedding array<float>")
    got = history_vectors(history, F.broadcast(embeddings), 2)
    above = plan_of(got).split("BroadcastHashJoin")[0]
    assert "ObjectHashAggregate" in above and "Exchange" not in above
    want = {("u", k): [[2.0 * k, 1.0], [2.0 * k + 1, 1.0]] for k in range(1, 60)} | {("v", 1): [], ("w", 1): []}
    assert {(r[0], r[1]): r["vectors"] for r in got.collect()} == want


def test_vectors_of_pairs_are_not_shuffled(spark):
    """Ids are dealt by batch before they get vectors, however small a table Spark would send by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(scored.vector_pairs(spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    users, items = plan.split("ObjectHashAggregate", 1)[0], plan[plan.index("ObjectHashAggregate") :]
    assert users.count("Exchange") == 1  # by batch, after the summaries
    assert not re.search(rf"Exchange hashpartitioning\({N.EMB}", plan)
    assert items.count("REPARTITION_BY_NUM") == 2
    assert all("embedding" not in line for line in items[items.index("REPARTITION_BY_NUM") :].splitlines() if "Exchange hashpartitioning" in line)
    assert items.rindex("BroadcastHashJoin") < items.rindex("REPARTITION_BY_NUM")


def test_lookup_within_and_beyond_the_limit(spark):
    big = spark.createDataFrame([(i % 5, i) for i in range(40)] + [(None, 40), (9, 41)], "k long, n long")
    small = spark.createDataFrame([(k, k * 10) for k in range(5)] + [(3, 31), (None, 0)], "k long, v long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, "k", how).collect()), key=repr)
        for row_bytes in (None, 8, 1 << 40):
            got = lookup_join(big, small, "k", how, row_bytes)
            assert sorted(map(tuple, got.collect()), key=repr) == want
    assert "BroadcastHashJoin" in plan_of(lookup_join(big, small, "k", row_bytes=8))


def test_pairs_keep_their_parts(spark):
    users = spark.createDataFrame([("train", 1, b, f"u{b}{i}") for b in range(4) for i in range(3)], f"split string, {N.HOUR} int, batch_id long, {N.USER} string")
    items = spark.createDataFrame(
        [("train", 1, b, f"p{p}", [f"u{b}{p % 3}"]) for b in range(4) for p in range(5)],
        f"split string, {N.HOUR} int, batch_id long, post_id string, likers array<string>",
    )
    pairs = cand.labelled_pairs(users, items)
    assert plan_of(pairs).count("REPARTITION_BY_NUM") == 2
    assert pairs.count() == 60 and pairs.where("label = 1").count() == 20


def test_compared_models_keep_their_parts(spark):
    pairs = spark.createDataFrame([("train", f"u{i % 7}", f"p{i}", i % 2, 0.1 * i) for i in range(50)], "split string, did string, post_id string, label int, s double")
    plan = plan_of(model_rows(pairs, {"m": ("kind", "s")}, ["split", "did"], [5]))
    assert re.findall(r"Exchange hashpartitioning\((?:.*?), (REPARTITION_BY_NUM|ENSURE_REQUIREMENTS)", plan) == ["REPARTITION_BY_NUM"]


def test_dot_of_known_length(spark):
    rows = [([1.5, 2.0], [3.0, 4.0]), ([1.0], [3.0, 4.0]), ([1.0, None], [3.0, 4.0]), (None, [3.0, 4.0]), ([1.0, 2.0, 3.0], [3.0, 4.0, 5.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<float>, b array<double>")
    got = df.select(vectors.dot("a", "b").alias("general"), vectors.dot("a", "b", 2).alias("known")).collect()
    assert [r.known for r in got] == [r.general for r in got] == [12.5, None, None, None, 26.0, 0.0]


def test_summary_on_arrow_batches(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 6.0]]), (2, []), (3, None), (4, [[1.0, None], [2.0, 3.0]]), (5, [[1.0, 2.0, 3.0]]), (6, [[1.0, 2.0], None])]
    df = spark.createDataFrame(rows, "i int, v array<array<float>>")
    got = df.select("i", vectors.summary_vector("v", 2, "linear_recency").alias("s"))
    assert "ArrowEvalPython" in plan_of(got)
    want = {1: [(2.0 + 3.0) / 3, (4.0 + 6.0) / 3], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [4 / 3, None], 5: [1.0, 2.0, None], 6: None}
    assert {r.i: r.s for r in got.collect()} == want


def test_core_parses_the_events_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(t, "core_tables", lambda likes, posts, *_: seen.extend((likes, posts)))
    t.build_core(spark, SF_DIR)
    likes, posts = seen
    assert not [f for df in (likes, posts) for f in df.inputFiles() if "events" in f or "embeddings" in f]
    assert sorted(map(tuple, likes.collect())) == sorted(map(tuple, t.raw_likes(spark, SF_DIR).collect()))
    assert sorted(r[0] for r in posts.collect()) == sorted(r[0] for r in t.raw_posts(spark, SF_DIR).collect())
