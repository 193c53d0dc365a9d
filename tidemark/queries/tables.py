"""The test tables seen as likes, posts and vectors, and the core tables built from them.

An event is a like; its post is the day's item of its key; authors are the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions.codec import encode_vector
from tidemark.functions.splits import Windows
from tidemark.operators.cohorts import eligible_users
from tidemark.operators.flow import CoreTables, Settings, core_tables, history_table
from tidemark.plans.durable import cut
from tidemark.session import use_utc
from tidemark.sources.embeddings import raw_vector
from tidemark.sources.tables import scan

WINDOWS = Windows("2024-01-01 00:00:00", "2024-01-21 00:00:00", "2024-01-26 00:00:00", "2024-01-31 00:00:00")
DIM = 64
MIN_LIKES = 2
MAX_LIKES = 40
NEGATIVE_SHARE = 0.5
MIN_NEGATIVE_LIKES = 2
NEGATIVES_PER_HOUR = 10
AUTHOR_SUPPORT = 20
MAX_PRIOR = 20
BATCH = 8
TOP_KS = [5, 30]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return scan(spark, f"{sf_dir}/{name}.parquet")


def raw_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(did, subject_uri, record_created_at)``, one row per event."""
    events = table(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k")
    return events.select(
        F.col("user_id").cast("string").alias(N.USER),
        F.concat(key, F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias(N.ITEM),
        F.col("ts").cast("timestamp").alias(N.TS),
    )


def author_of(uri: str) -> Column:
    return F.substring_index(uri, "@", 1)


def raw_posts(spark: SparkSession, sf_dir: str, with_vectors: bool = False, likes: DataFrame | None = None) -> DataFrame:
    """One post per item, made at its first like; on demand with its vector.

    ``likes`` may be the written likes, where they are at hand.
    """
    posts = (
        (raw_likes(spark, sf_dir) if likes is None else likes)
        .groupBy(F.col(N.ITEM).alias(N.POST))
        .agg(F.min(N.TS).alias(N.TS))
        .withColumns({N.USER: author_of(N.POST), "record_text": F.col(N.POST)})
    )
    if not with_vectors:
        return posts
    day = F.dayofmonth(N.TS)
    keyed = posts.withColumn("vec_id", author_of(N.POST).cast("long") + (day % 6) * 100)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return keyed.join(vectors, "vec_id", "left").drop("vec_id")


MODEL = "all_MiniLM_L6_v2"


def encoded_vector(vector: Column | str) -> Column:
    """A vector as raw posts carry it: a list of ``{key, value}`` with text bodies."""
    return F.array(
        F.struct(F.lit("other").alias("key"), F.lit("unused").alias("value")),
        F.struct(F.lit(MODEL).alias("key"), encode_vector(vector).alias("value")),
    )


def encoded_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts with encoded vectors; by their hash some come again, a moment later, with a vector that is
    cut short, some with a negated one, and some with both.

    Posts without a vector have a null list.
    """
    posts = raw_posts(spark, sf_dir, with_vectors=True)
    digit = F.conv(F.substring(F.md5(N.POST), 1, 6), 16, 10).cast("long")
    later = lambda us: (F.unix_micros(N.TS) + us).cast("long")
    half = posts.where(digit % 2 == 1).withColumns(
        {N.TS: F.timestamp_micros(later(1)), "embedding": F.slice("embedding", 1, DIM // 2)}
    )
    other = posts.where(F.floor(digit / 2) % 2 == 1).withColumns(
        {N.TS: F.timestamp_micros(later(2)), "embedding": F.transform("embedding", lambda x: -x)}
    )
    every = posts.unionByName(half).unionByName(other)
    encoded = F.when(F.col("embedding").isNotNull(), encoded_vector("embedding"))
    return every.withColumn("embeddings", encoded).drop("embedding")


def orders_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as likes: customer, part, order date, with the supplier as author."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias(N.USER),
        F.col("l_partkey").cast("string").alias(N.ITEM),
        F.col("o_orderdate").cast("timestamp").alias(N.TS),
        F.col("l_suppkey").cast("string").alias(N.AUTHOR),
    )


_settings: dict[tuple[str, str], Settings] = {}


def settings(spark: SparkSession, sf_dir: str) -> Settings:
    """Test settings: six in ten eligible users for training, three in ten unseen; users are counted once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _settings:
        _settings[key] = _settings_of(eligible_users(raw_likes(spark, sf_dir), MIN_LIKES).count())
    return _settings[key]


def _settings_of(eligible: int) -> Settings:
    return Settings(
        windows=WINDOWS,
        min_likes=MIN_LIKES,
        max_likes=MAX_LIKES,
        max_trainval=eligible * 6 // 10,
        max_unseen=eligible * 3 // 10,
        negative_share=NEGATIVE_SHARE,
        min_negative_likes=MIN_NEGATIVE_LIKES,
        negatives_per_hour=NEGATIVES_PER_HOUR,
        min_author_support=AUTHOR_SUPPORT,
        max_prior=MAX_PRIOR,
    )


_core: dict[tuple[str, str], CoreTables] = {}
_history: dict[tuple[str, str], DataFrame] = {}


def build_core(spark: SparkSession, sf_dir: str, folder: str | None = None, encoded: bool = False) -> CoreTables:
    # Likes and posts are read many times: the events are parsed once and both are written.
    likes = cut(raw_likes(spark, sf_dir))
    return core_tables(
        likes,
        encoded_posts(spark, sf_dir) if encoded else cut(raw_posts(spark, sf_dir, with_vectors=True, likes=likes)),
        settings(spark, sf_dir),
        raw_vector(MODEL) if encoded else F.col("embedding"),
        DIM,
        folder,
    )


def core(spark: SparkSession, sf_dir: str) -> CoreTables:
    """The written core tables; later stages start from them, once per session."""
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _core:
        _core[key] = build_core(spark, sf_dir)
    return _core[key]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written user history of the core tables."""
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _history:
        _history[key] = history_table(core(spark, sf_dir), settings(spark, sf_dir))
    return _history[key]


def time_text(col: Column | str) -> Column:
    """Times leave the queries as text, which every engine writes the same way."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def micro_text(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def list_text(col: Column | str) -> Column:
    """A list of whole numbers or texts as comma separated text; null entries as ``-``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",", "-")


def rounded(col: Column | str, digits: int = 6) -> Column:
    """A float ready for comparison; -0.0 becomes 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)
