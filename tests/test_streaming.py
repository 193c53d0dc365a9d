"""The streamed hourly counts equal the batch ones for every finished hour."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.operators.popularity import hourly_likes
from tidemark.queries.tables import raw_likes
from tidemark.streaming.hourly import append_to_table, hourly_likes_stream, likes_stream

SF = "/root/testdata/sf0.001"


def test_finished_hours_equal_the_batch_counts(spark, tmp_path):
    likes = raw_likes(spark, SF)
    folder, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    for start, end in ((1, 9), (9, 20), (20, 32)):
        part = likes.where(F.dayofmonth(N.TS).between(start, end - 1))
        part.write.mode("append").parquet(folder)
        stream = likes_stream(spark, folder, likes.schema)
        append_to_table(hourly_likes_stream(stream), out, state).awaitTermination(120)
    newest = likes.agg(F.max(N.TS)).first()[0]
    final = newest - timedelta(hours=2)
    batch = hourly_likes(likes).where(F.col("like_hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(final))
    streamed = spark.read.parquet(out)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
