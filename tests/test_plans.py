"""Plan helpers against brute force, with one key that holds a third of the rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_hash
from tidemark.plans import ordered
from tidemark.plans.asof import asof_backward
from tidemark.plans.spread import heavy_keys, semi_join_spread, spread_join
from tidemark.plans.sizes import broadcast_if_bounded
from tidemark.plans.topn import one_per_key, salt_of, top_n_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"
        rows.append((key, rng.choice([0.0, 0.0, rng.random(), rng.randrange(50) / 10]), i))
    frame = pd.DataFrame(rows, columns=["key", "x", "id"])
    return spark.createDataFrame(frame).cache(), frame


@pytest.fixture
def whole_parts(spark):
    """Small parts stay apart, as those of large tables do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def part(column=ordered.PLACE):
    return F.shiftright(column, ordered.PLACE_BITS)


def test_ranged_places_follow_the_order(skewed, whole_parts):
    df, frame = skewed
    rows = ordered.ranged(df, ["x", "id"]).orderBy(ordered.PLACE).select("x", "id", part().alias("p")).toPandas()
    assert rows["id"].tolist() == frame.sort_values(["x", "id"])["id"].tolist()
    assert rows["p"].is_monotonic_increasing and rows["p"].nunique() > 4


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_running_before_matches_brute_force(skewed, keys, whole_parts):
    df, frame = skewed
    out = ordered.running_before(
        df, keys, ["x", "id"], {"position": F.lit(1).cast("long"), "total": F.col("x")}
    ).toPandas().sort_values("id").reset_index(drop=True)
    want = frame.sort_values(["x", "id"]).copy()
    groups = want.groupby("key") if keys else want.assign(_="all").groupby("_")
    want["position"] = groups.cumcount()
    want["total"] = groups["x"].cumsum() - want["x"]
    want = want.sort_values("id").reset_index(drop=True)
    assert (out["position"] == want["position"]).all()
    assert np.allclose(out["total"], want["total"])


def test_hot_key_alone_is_cut(skewed, whole_parts):
    """A key with a third of the rows lies in several parts; pieces are as many as keys and cuts."""
    df, _ = skewed
    pieces = ordered.ranged(df, ["key", "x", "id"]).groupBy("key", part().alias("p")).count().toPandas()
    hot = pieces[pieces["key"] == "hot"]
    assert len(hot) > 2 and hot["count"].max() < 2000 * 0.6
    assert len(pieces) <= pieces["key"].nunique() + 8


def test_one_exchange_and_no_tree(skewed):
    """Global positions: the plan that writes has one range exchange, the one that reads compares nothing."""
    df, _ = skewed
    placed = df.repartitionByRange("x", "id").sortWithinPartitions("x", "id").withColumn("p", F.monotonically_increasing_id())
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "rangepartitioning" in text
    text = ordered.with_position(df, [], ["x", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "CASE" not in text and "rangepartitioning" not in text


def test_positions_survive_an_input_hashed_on_the_key(skewed):
    df, _ = skewed
    plan = ordered.running_before(df.repartition(8, "key"), ["key"], ["x", "id"], {"p": F.lit(1)})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_group" in text


@pytest.mark.parametrize("rows", [1, 200, 5000])
def test_nulls_come_first_at_every_size(spark, rows):
    values = [(i, None if i % 10 == 0 else float((i * 37) % 101), float("nan") if i % 7 == 3 else 0.5) for i in range(rows)]
    df = spark.createDataFrame(values, "id long, x double, y double")
    got = {r["id"]: r["position"] for r in ordered.with_position(df, [], ["x", "y", "id"]).collect()}
    want = sorted(values, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2] != r[2], r[0]))
    assert got == {r[0]: k for k, r in enumerate(want)}


def test_a_table_of_nulls_alone(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)], "x string, id long")
    got = {r["id"]: r["position"] for r in ordered.with_position(df, [], ["x", "id"]).collect()}
    assert got == {i: i for i in range(50)}


@pytest.mark.parametrize("n", [0, 1, 137, 6000, 9000])
def test_first_by_hash_takes_exactly_n(skewed, n):
    df, frame = skewed
    hashed = df.withColumn("h", seeded_hash(1, "t", "id"))
    got = ordered.first_by_hash(hashed, n, "h", ["id"]).toPandas()
    want = hashed.toPandas().sort_values(["h", "id"]).head(n)
    assert sorted(got["id"]) == sorted(want["id"])


def test_first_by_hash_of_groups(skewed):
    df, _ = skewed
    hashed = df.withColumn("h", seeded_hash(1, "t", "id")).withColumn("g", F.col("id") % 3)
    got = ordered.first_by_hash(hashed, 50, "h", ["id"], ["g"]).toPandas()
    want = hashed.toPandas().sort_values(["h", "id"]).groupby("g").head(50)
    assert sorted(got["id"]) == sorted(want["id"])


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_exact_quantiles(skewed, keys):
    df, frame = skewed
    qs = {"median": 0.5, "p90": 0.9, "p99": 0.99}
    got = ordered.exact_quantiles(df, keys, "x", qs).toPandas()
    if not keys:
        assert np.allclose(got.iloc[0][list(qs)].astype(float), np.percentile(frame["x"], [50, 90, 99]))
        return
    got = got.set_index("key")
    for key, part in frame.groupby("key"):
        assert np.allclose(got.loc[key, list(qs)].astype(float), np.percentile(part["x"], [50, 90, 99]))


def test_nearest_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    row = ordered.exact_quantiles(df, [], "x", {"q": 0.25, "r": 0.9}, nearest=True).first()
    assert (row.q, row.r) == (2.0, 8.0)


@pytest.mark.parametrize("salted", [False, True])
def test_top_n_per_group(skewed, salted):
    df, frame = skewed
    salt = salt_of("id") if salted else None
    got = top_n_per_group(df, ["key"], [F.col("x").desc(), "id"], 7, salt).toPandas()
    want = frame.sort_values(["x", "id"], ascending=[False, True]).groupby("key").head(7)
    assert sorted(got["id"]) == sorted(want["id"])


def test_top_n_cuts_in_the_map_tasks(skewed):
    df, _ = skewed
    text = top_n_per_group(df, ["key"], ["x", "id"], 7, salt_of("id"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Partial") == 2


def test_one_per_key(skewed):
    df, frame = skewed
    got = one_per_key(df, ["key"], ["x", "id"]).toPandas()
    want = frame.sort_values(["x", "id"]).groupby("key").head(1)
    assert sorted(got["id"]) == sorted(want["id"])


@pytest.mark.parametrize("segment", [None, "day", "month"])
def test_asof_matches_merge_asof(spark, segment):
    rng = random.Random(9)
    start = pd.Timestamp("2024-01-01")

    def times(n):
        return [start + pd.Timedelta(seconds=rng.randrange(40 * 86400)) for _ in range(n)]

    def keys(n):
        return ["hot" if i % 3 == 0 else f"k{rng.randrange(30)}" for i in range(n)]

    curve = pd.DataFrame({"key": keys(800), "t": times(800), "v": range(800)}).drop_duplicates(["key", "t"])
    targets = pd.DataFrame({"key": keys(600), "at": times(600)})
    targets = pd.concat([targets, curve.head(20).rename(columns={"t": "at"})[["key", "at"]]]).drop_duplicates()
    got = asof_backward(
        spark.createDataFrame(targets), spark.createDataFrame(curve), "key", "at", "t", "v", default=-1, segment=segment
    ).toPandas()
    want = pd.merge_asof(
        targets.sort_values("at"), curve.sort_values("t"), left_on="at", right_on="t", by="key", direction="backward"
    )
    want["v"] = want["v"].fillna(-1).astype(int)
    assert sorted(map(tuple, got[["key", "at", "v"]].values.tolist())) == sorted(
        map(tuple, want[["key", "at", "v"]].values.tolist())
    )


def test_semi_join_spreads_the_copies(spark, skewed):
    df, frame = skewed
    keys = spark.createDataFrame([("hot",), ("k3",), ("hot",), ("absent",)], "key string")
    got = semi_join_spread(df.repartition(12, "id"), keys, "key").toPandas()
    want = frame[frame["key"].isin(["hot", "k3"])]
    assert sorted(got["id"]) == sorted(want["id"]) and list(got.columns) == ["key", "x", "id"]


def test_null_keys_are_a_group_of_their_own(spark):
    df = spark.createDataFrame([(None, i) for i in range(3)] + [("a", i) for i in range(2)], "k string, x int")
    out = ordered.running_before(df, ["k"], ["x"], {"p": F.lit(1)}, F.col("x") % 1 + F.floor(F.col("x") / 2))
    assert sorted((r.k or "", r.x, r.p) for r in out.collect()) == [
        ("", 0, 0), ("", 1, 1), ("", 2, 2), ("a", 0, 0), ("a", 1, 1),
    ]


def test_broadcast_needs_a_bound(spark):
    df = spark.range(5)
    assert broadcast_if_bounded(df, 1000, 100)[1]
    assert not broadcast_if_bounded(df, 10**9, 100)[1]
    assert not broadcast_if_bounded(df, None, 1)[1]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("measured", [False, True])
def test_spread_join_equals_a_join(spark, skewed, how, measured):
    df, frame = skewed
    small = spark.createDataFrame([("hot", 1), ("hot", 2)] + [(f"k{i}", 3) for i in range(0, 300, 3)], "key string, v int")
    got = spread_join(df, small, "key", how, df.select("key") if measured else None)
    want = df.join(small, "key", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "_part" in plan


def test_spread_join_of_two_keys_and_nulls(spark):
    rows = [(None if i % 3 else "a", i % 2, i) for i in range(900)]
    big = spark.createDataFrame(rows, "k string, h int, i int")
    small = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), (None, 0, "z")], "k string, h int, v string")
    for how in ("inner", "left"):
        got, want = spread_join(big, small, ["k", "h"], how), big.join(small, ["k", "h"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        spread_join(big, small, ["k", "h"], "outer")


def test_heavy_keys_names_hot_keys_alone(spark, skewed):
    df, _ = skewed
    found = heavy_keys(df, ["key"], 32).collect()
    hot = df.where("key = 'hot'").select(F.xxhash64("key")).first()[0]
    assert [(r["_heavy"], r["_copies"]) for r in found] == [(hot, 11)]
    assert heavy_keys(spark.range(5000), ["id"]) is None
    assert heavy_keys(spark.range(0), ["id"]) is None


def test_hot_rows_lie_in_several_tasks(spark, skewed):
    """The hot key's rows reach the join in more than one partition, equal rows too."""
    df, _ = skewed
    hot = df.where("key = 'hot'").select("key").repartition(8)
    joined = spread_join(hot, spark.createDataFrame([("hot", 1)], "key string, v int"), "key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 2000 and len(sizes) > 3 and max(sizes) < 1200
