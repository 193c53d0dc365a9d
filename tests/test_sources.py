"""Scans, stamped files, filters and sinks."""

import datetime as dt
import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables as io

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_needs_paths(spark):
    with pytest.raises(ValueError):
        io.scan(spark)
    assert io.scan(spark, f"{SF}/orders.parquet", f"{SF}/orders.parquet").count() == 2 * io.scan(spark, f"{SF}/orders.parquet").count()


def test_stamped_files(spark, tmp_path):
    names = ["likes_20240101_000000", "likes_20240101_010000", "likes_20240102_000000", "likes_2024_bad", "posts_20240101_000000"]
    for i, name in enumerate(names):
        spark.range(i, i + 1).coalesce(1).write.parquet(str(tmp_path / "raw" / name))
        part = next((tmp_path / "raw" / name).glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.parquet").write_bytes(part.read_bytes())
    folder = str(tmp_path / "in")
    files = io.list_stamped_files(spark, folder, "likes").collect()
    assert sorted(r.stamp for r in files) == [
        dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 2),
    ]
    chosen = io.scan_stamped(spark, folder, "likes", "2024-01-01 01:00:00", "2024-01-02 00:00:00")
    assert [r.id for r in chosen.collect()] == [1]
    with pytest.raises(ValueError, match="no likes files"):
        io.scan_stamped(spark, folder, "likes", "2025-01-01")


def test_stamp_globs_match_the_window_alone():
    """Patterns against names, for many windows over 100,000 hourly names and names between hours."""
    first = dt.datetime(2019, 11, 28)
    names = [f"likes_{first + dt.timedelta(hours=h):%Y%m%d_%H%M%S}.parquet" for h in range(100_000)]
    names += ["likes_20240101_003000.parquet", "likes_20240101_005959.parquet", "posts_20240101_000000.parquet", "likes_2024_bad.parquet"]
    found = [re.fullmatch(r"likes_(\d{8})_(\d{6})\.parquet", name) for name in names]
    stamps = [m and "".join(m.groups()) for m in found]
    bounds = ["2024-01-01", "2024-01-01 00:30:00", "2023-12-31T23:00:00", "2024-01-01 00:59:59", "2031-01-01"]
    digits = lambda b: f"{dt.datetime.fromisoformat(b):%Y%m%d%H%M%S}"
    for start, end in [(None, None), *[(b, None) for b in bounds[:2]], *[(None, b) for b in bounds[:2]], *zip(bounds, bounds[1:]), ("2020-02-29 05:00:00", "2029-07-01")]:
        globs = io.stamp_globs("likes", start, end)
        assert len(globs) <= 28
        whole = re.compile("|".join(fnmatch.translate(g) for g in globs) or "(?!)")
        low, high = digits(start) if start else "", digits(end) if end else ":"
        assert [n for n in names if whole.match(n)] == [n for n, s in zip(names, stamps) if s and low <= s < high]
    assert io.stamp_globs("likes", "2024-01-01 00:00:00.5", "2024-01-01 00:00:01") == []


def test_stamped_files_round_trip(spark, tmp_path):
    """Many hours, hours in several batches, a null time; a second write replaces the files."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(2000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, record_created_at timestamp").repartition(4)
    for _ in range(2):
        io.write_stamped(df, str(tmp_path / "out"), "likes")
    assert len(list((tmp_path / "out").iterdir())) == len({r[1].replace(minute=0) for r in rows if r[1]})
    back = io.scan_stamped(spark, str(tmp_path / "out"), "likes", "2024-01-02", "2024-01-03 06:00:00")
    want = [r for r in rows if r[1] and dt.datetime(2024, 1, 2) <= r[1] < dt.datetime(2024, 1, 3, 6)]
    assert sorted(map(tuple, back.collect())) == want


def test_file_stamp_of_other_names(spark):
    names = ["a/likes_20240101_120000.parquet", "a/xlikes_20240101_120000.parquet", "a/likes_20240101.parquet"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r.s for r in df.select(io.file_stamp(F.col("p"), "likes").alias("s")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 12), None, None]


def test_time_filter_reaches_the_scan(spark):
    events = io.scan(spark, f"{SF}/events.parquet").select("event_id", "ts")
    kept = io.time_between(events, "ts", "2024-01-05", "2024-01-06")
    text = plan(kept)
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text
    assert 0 < kept.count() < events.count()
    with pytest.raises(ValueError, match="no column"):
        io.time_between(events, "absent", "2024-01-05")


def test_text_times_compare_as_text(spark):
    df = spark.createDataFrame([("2024-01-02T00:00:00",), ("2024-01-03T00:00:00",)], "record_created_at string")
    assert io.time_between(df, start="2024-01-02T00:00:00", end="2024-01-03T00:00:00").count() == 1
    assert io.time_between(df).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "k string, n int, x double")
    io.write_table(df, str(tmp_path / "t"))
    assert list((tmp_path / "t").glob("*.zstd.parquet"))
    io.write_csv(df, str(tmp_path / "c"))
    lines = [l for f in (tmp_path / "c").glob("*.csv") for l in f.read_text().splitlines()]
    assert "k,n,x" in lines and "a,1," in lines
    io.write_json(df, str(tmp_path / "j"))
    assert any('"x":null' in f.read_text() for f in (tmp_path / "j").glob("*.json"))
