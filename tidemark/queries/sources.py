"""Scans, file selection, filters, sinks and the embedding table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import names as N
from tidemark.functions.codec import decode_vector
from tidemark.functions.times import parse_timestamp
from tidemark.functions.vectors import pick_embedding
from tidemark.plans.durable import ensure_checkpoint_dir
from tidemark.queries import tables as t
from tidemark.queries.oracle import VAL, HOLD, hour, micro, rnd, with_
from tidemark.queries.registry import query
from tidemark.sources import embeddings as emb
from tidemark.sources import tables as io


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


@query(
    "a1_parquet_scan",
    """SELECT 'orders' AS source, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys FROM orders
       UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey) FROM lineitem
       UNION ALL SELECT 'events', count(*), count(DISTINCT event_id) FROM events""",
)
def a1(spark: SparkSession, sf: str) -> DataFrame:
    t.use_utc(spark)
    parts = []
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "event_id")):
        per_key = io.scan(spark, f"{sf}/{name}.parquet").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).select(
                F.lit(name).alias("source"), "n_rows", "n_keys"
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


A2_START, A2_END = "2024-01-05 06:00:00", "2024-01-20 00:00:00"


@query(
    "a2_stamped_files",
    f"""SELECT {hour("date_trunc('hour', ts)")} AS stamp, count(*) AS n_rows,
               {micro('min(ts)')} AS first_ts, {micro('max(ts)')} AS last_ts FROM events
        WHERE date_trunc('hour', ts) >= TIMESTAMP '{A2_START}' AND date_trunc('hour', ts) < TIMESTAMP '{A2_END}'
        GROUP BY ALL""",
)
def a2(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the given tables as stamped files, one an hour, then read back by window."""
    folder = shared_folder(spark, "stamped")
    io.write_stamped(t.raw_likes(spark, sf), folder, "likes")
    found = io.scan_stamped(spark, folder, "likes", A2_START, A2_END)
    stamp = io.file_stamp(F.col("_metadata.file_path"), "likes")
    return (
        found.select(t.time_text(stamp).alias("stamp"), N.TS)
        .groupBy("stamp")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(N.TS).alias("a"), F.max(N.TS).alias("b"))
        .select("stamp", "n_rows", t.micro_text("a").alias("first_ts"), t.micro_text("b").alias("last_ts"))
    )


@query(
    "a3_time_filter",
    f"SELECT event_id, {micro('ts')} AS ts FROM events WHERE ts >= {VAL} AND ts < {HOLD}",
)
def a3(spark: SparkSession, sf: str) -> DataFrame:
    events = t.table(spark, sf, "events").select("event_id", "ts")
    kept = io.time_between(events, "ts", t.WINDOWS.val_start, t.WINDOWS.holdout_start)
    return kept.select("event_id", t.micro_text("ts").alias("ts"))


@query(
    "a3_time_filter_text",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created FROM events
        WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-21' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') < '2024-01-26'""",
)
def a3_text(spark: SparkSession, sf: str) -> DataFrame:
    text = t.table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created")
    )
    return io.time_between(text, "created", "2024-01-21", "2024-01-26")


@query(
    "a4_timestamp_parse",
    f"""SELECT event_id, {hour('''CASE event_id % 4
            WHEN 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
            WHEN 1 THEN date_trunc('second', ts)
            WHEN 2 THEN date_trunc('second', ts) + INTERVAL 90 MINUTE
            ELSE date_trunc('day', ts) END''')} AS parsed FROM events""",
)
def a4(spark: SparkSession, sf: str) -> DataFrame:
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(local, F.lit("+0200")))
        .when(kind == 1, local)
        .when(kind == 2, F.concat(local, F.lit("-01:30")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    events = t.table(spark, sf, "events").select("event_id", text.alias("raw"))
    return events.select("event_id", t.time_text(parse_timestamp("raw")).alias("parsed"))


@query(
    "a5_parquet_zstd",
    f"""SELECT o_orderstatus, count(*) AS n_orders, {rnd('sum(o_totalprice)', 2)} AS total
        FROM orders GROUP BY ALL""",
)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "orders")
    io.write_table(t.table(spark, sf, "orders"), folder)
    back = io.scan(spark, folder)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), t.rounded(F.sum("o_totalprice"), 2).alias("total")
    )


RESULT_SQL = """
    SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars,
           CAST(max(CASE WHEN quality = 0 THEN d.doc_id END) AS DOUBLE) AS last_poor
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL"""


def _result_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = t.table(spark, sf, "labels").select("doc_id", "quality")
    return (
        docs.join(labels, "doc_id", "left")
        .groupBy("lang", "source")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum("n_chars").alias("n_chars"),
            F.max(F.when(F.col("quality") == 0, F.col("doc_id"))).cast("double").alias("last_poor"),
        )
    )


RESULT_SCHEMA = "lang string, source string, n_docs bigint, n_chars bigint, last_poor double"


@query("a6_csv_sink", RESULT_SQL)
def a6_csv(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    io.write_csv(_result_table(spark, sf), folder)
    return spark.read.schema(RESULT_SCHEMA).option("header", True).csv(folder)


@query("a6_json_sink", RESULT_SQL)
def a6_json(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "json")
    io.write_json(_result_table(spark, sf), folder)
    return spark.read.schema(RESULT_SCHEMA).json(folder)


EMB_SQL = """
    SELECT at_uri, emb_idx, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS vector_sum
    FROM emb_table"""


@query("a9_embedding_table", with_(EMB_SQL))
def a9(spark: SparkSession, sf: str) -> DataFrame:
    posts = t.raw_posts(spark, sf, with_vectors=True)
    vectors = emb.candidate_vectors(posts, t.core(spark, sf).sampled_posts, F.col("embedding"))
    table = emb.embedding_table(vectors, t.DIM)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return table.select(N.POST, F.col(N.EMB).cast("long").alias(N.EMB), F.round(total, 6).alias("vector_sum"))


@query(
    "a9_embedding_stats",
    with_(
        """SELECT (SELECT count(*) FROM sampled_posts) AS n_posts_candidate,
                  (SELECT count(DISTINCT at_uri) FROM sampled_posts) AS n_posts_candidate_unique,
                  count(embedding) AS n_embeddings_valid,
                  CAST(sum(CASE WHEN embedding IS NULL THEN 1 + nth % 2 + (nth // 2) % 2 ELSE 0 END) AS BIGINT) AS n_embeddings_null,
                  CAST(sum(CASE WHEN embedding IS NOT NULL THEN nth % 2 ELSE 0 END) AS BIGINT) AS n_embeddings_wrong_dim,
                  CAST(sum(CASE WHEN embedding IS NOT NULL THEN (nth // 2) % 2 ELSE 0 END) AS BIGINT) AS n_embeddings_duplicate_uri,
                  (SELECT count(DISTINCT at_uri) FROM sampled_posts) - count(embedding)
                    AS n_posts_dropped_no_embedding
           FROM (SELECT *, CAST('0x' || substr(md5(at_uri), 1, 6) AS BIGINT) % 4 AS nth FROM post_vectors)
           WHERE at_uri IN (SELECT at_uri FROM sampled_posts)"""
    ),
)
def a9_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over encoded posts that come again with short and with other vectors."""
    posts = t.encoded_posts(spark, sf)
    candidates = t.core(spark, sf).sampled_posts
    return emb.embedding_stats(emb.candidate_vectors(posts, candidates, emb.raw_vector(t.MODEL)), candidates, t.DIM)


@query(
    "a9_first_vector",
    with_("""SELECT at_uri, emb_idx, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS vector_sum
             FROM emb_table"""),
)
def a9_first(spark: SparkSession, sf: str) -> DataFrame:
    """The table of the same encoded posts: the first vector of the right length counts."""
    posts = t.encoded_posts(spark, sf)
    vectors = emb.candidate_vectors(posts, t.core(spark, sf).sampled_posts, emb.raw_vector(t.MODEL))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return emb.embedding_table(vectors, t.DIM).select(N.POST, N.EMB, F.round(total, 6).alias("vector_sum"))


def encoded_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "embeddings").select("vec_id", t.encoded_vector("embedding").alias("embeddings"))


@query(
    "b2_decode_embedding",
    """SELECT vec_id, len(embedding) AS dim,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS vector_sum,
              round(CAST(list_extract(embedding, 64) AS DOUBLE), 6) AS last_value
       FROM embeddings""",
)
def b2(spark: SparkSession, sf: str) -> DataFrame:
    """Write the vectors in their text form and decode them again."""
    decoded = encoded_vectors(spark, sf).select(
        "vec_id", decode_vector(pick_embedding("embeddings", "all_MiniLM_L6_v2")).alias("v")
    )
    return decoded.select(
        "vec_id",
        F.size("v").alias("dim"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vector_sum"),
        F.round(F.element_at("v", -1).cast("double"), 6).alias("last_value"),
    )
