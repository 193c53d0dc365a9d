"""The hourly like counts over a growing folder of likes files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.names import ITEM, TS


def likes_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """Likes files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_likes_stream(likes: DataFrame, key: str = ITEM, late: str = "2 hours") -> DataFrame:
    """Likes per post and hour, each final once no like of its hour can come any more.

    The state holds the open hours only: ``late`` says how far behind the newest
    like an older one may come.
    """
    return (
        likes.withWatermark(TS, late)
        .groupBy(F.window(TS, "1 hour"), key)
        .agg(F.count(F.lit(1)).alias("likes_this_hour"))
        .select(key, F.col("window.start").alias("like_hour"), "likes_this_hour")
    )


def append_to_table(hourly: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the finished hours to a parquet table with what files there are, then stop."""
    return (
        hourly.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
