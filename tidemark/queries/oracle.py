"""SQL building blocks of the checks: named common table expressions and who needs whom."""

from __future__ import annotations

import re

from tidemark.queries.tables import (
    AUTHOR_SUPPORT,
    BATCH,
    DIM,
    MAX_LIKES,
    MAX_PRIOR,
    MIN_LIKES,
    MIN_NEGATIVE_LIKES,
    NEGATIVE_SHARE,
    NEGATIVES_PER_HOUR,
    TOP_KS,
    WINDOWS,
)

TRAIN, VAL, HOLD, END = (
    f"TIMESTAMP '{t}'"
    for t in (WINDOWS.train_start, WINDOWS.val_start, WINDOWS.holdout_start, WINDOWS.holdout_end)
)


def uniform(hash_sql: str) -> str:
    return f"((CAST('0x' || substr({hash_sql}, 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def window_case(ts: str) -> str:
    return (
        f"CASE WHEN {ts} >= {TRAIN} AND {ts} < {VAL} THEN 'train' "
        f"WHEN {ts} >= {VAL} AND {ts} < {HOLD} THEN 'val' WHEN {ts} >= {HOLD} THEN 'holdout' END"
    )


def hour(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def micro(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def listed(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',')"


SPLIT_WINDOW = (
    "CASE WHEN split = 'val_unseen_users' THEN 'val' WHEN split LIKE 'holdout%' THEN 'holdout' ELSE split END"
)

CTES: dict[str, str] = {
    "raw_likes": """
        SELECT CAST(user_id AS VARCHAR) AS did,
               regexp_extract(props, '[0-9]+') || '@' || strftime(ts, '%Y-%m-%d') AS subject_uri,
               ts AS record_created_at
        FROM events""",
    "raw_posts": """
        SELECT subject_uri AS at_uri, min(record_created_at) AS record_created_at,
               split_part(subject_uri, '@', 1) AS did, subject_uri AS record_text
        FROM raw_likes GROUP BY subject_uri""",
    "post_vectors": """
        SELECT p.*, e.embedding
        FROM raw_posts p LEFT JOIN embeddings e
          ON e.vec_id = CAST(p.did AS BIGINT) + (day(p.record_created_at) % 6) * 100""",
    "user_counts": "SELECT did, count(*) AS like_count FROM raw_likes GROUP BY did",
    "eligible": f"SELECT * FROM user_counts WHERE like_count >= {MIN_LIKES}",
    "trainval": """
        SELECT did, like_count FROM (
          SELECT *, row_number() OVER (ORDER BY md5('42:trainval:' || did), did) AS rn FROM eligible)
        WHERE rn <= (SELECT count(*) * 6 // 10 FROM eligible)""",
    "unseen": """
        SELECT did, like_count FROM (
          SELECT *, row_number() OVER (ORDER BY md5('42:unseen_eval:' || did), did) AS rn
          FROM eligible WHERE did NOT IN (SELECT did FROM trainval))
        WHERE rn <= (SELECT count(*) * 3 // 10 FROM eligible)""",
    "cohorts": """
        SELECT *, 'trainval' AS user_cohort FROM trainval
        UNION ALL SELECT *, 'unseen_eval' AS user_cohort FROM unseen""",
    "labelled": f"""
        SELECT did, subject_uri, record_created_at, like_count,
               CASE WHEN user_cohort = 'trainval' AND w = 'holdout' THEN 'holdout_seen_users'
                    WHEN user_cohort = 'trainval' THEN w
                    WHEN w = 'val' THEN 'val_unseen_users'
                    WHEN w = 'holdout' THEN 'holdout_unseen_users' END AS split
        FROM (SELECT l.*, c.like_count, c.user_cohort, {window_case('record_created_at')} AS w
              FROM raw_likes l JOIN cohorts c USING (did))
        WHERE record_created_at < {END}
          AND ((user_cohort = 'trainval' AND record_created_at >= {TRAIN})
            OR (user_cohort = 'unseen_eval' AND record_created_at >= {VAL}))""",
    "sampled_likes": f"""
        SELECT DISTINCT did, subject_uri, record_created_at, split,
               date_trunc('hour', record_created_at) AS like_hour_bucket
        FROM (SELECT *, row_number() OVER (PARTITION BY did
                ORDER BY md5('42:cap:' || did || ':' || subject_uri), subject_uri, record_created_at) AS rn
              FROM labelled)
        WHERE rn <= {MAX_LIKES}""",
    "sampled_counts": f"""
        SELECT subject_uri, count(*) AS global_like_count FROM raw_likes
        WHERE CAST('0x' || substr(md5('42:candidate:' || subject_uri), 1, 8) AS BIGINT) / 4294967296.0
              < {NEGATIVE_SHARE}
        GROUP BY subject_uri""",
    "candidate_counts": f"SELECT * FROM sampled_counts WHERE global_like_count >= {MIN_NEGATIVE_LIKES}",
    "window_posts": f"SELECT * FROM raw_posts WHERE record_created_at >= {TRAIN} AND record_created_at < {END}",
    "expanded": """
        SELECT p.at_uri, c.global_like_count,
               date_trunc('hour', p.record_created_at) + to_hours(CAST(h.i AS INTEGER)) AS negative_hour_bucket
        FROM window_posts p JOIN candidate_counts c ON c.subject_uri = p.at_uri, range(24) h(i)""",
    "scored": f"""
        SELECT *, -ln({uniform("md5('42:negative:' || at_uri || ':' || " + hour('negative_hour_bucket') + ")")})
                  / pow(global_like_count, 0.15) AS sample_score
        FROM expanded
        WHERE negative_hour_bucket >= {TRAIN} AND negative_hour_bucket < {END}""",
    "chosen": f"""
        SELECT at_uri, negative_hour_bucket FROM (
          SELECT *, row_number() OVER (PARTITION BY negative_hour_bucket ORDER BY sample_score, at_uri) AS rn
          FROM scored)
        WHERE rn <= {NEGATIVES_PER_HOUR}""",
    "negatives": """
        SELECT p.at_uri, p.record_created_at, p.did, p.record_text,
               p.at_uri IN (SELECT subject_uri FROM sampled_likes) AS is_liked,
               true AS in_random_sample, c.negative_hour_bucket
        FROM chosen c JOIN window_posts p USING (at_uri)""",
    "sampled_posts": f"""
        SELECT *, {window_case("CASE WHEN in_random_sample THEN negative_hour_bucket ELSE record_created_at END")}
                  AS split_window
        FROM (SELECT * FROM negatives
              UNION ALL
              SELECT at_uri, record_created_at, did, record_text, true, false, NULL
              FROM window_posts
              WHERE at_uri IN (SELECT subject_uri FROM sampled_likes)
                AND at_uri NOT IN (SELECT at_uri FROM negatives))""",
    "needed": """
        SELECT DISTINCT subject_uri, like_hour_bucket AS target_hour FROM sampled_likes
        UNION
        SELECT DISTINCT at_uri, negative_hour_bucket FROM sampled_posts WHERE in_random_sample""",
    "hourly": """
        SELECT subject_uri, date_trunc('hour', record_created_at) AS like_hour, count(*) AS likes_this_hour
        FROM raw_likes GROUP BY ALL""",
    "prior": """
        SELECT n.subject_uri, n.target_hour, CAST(coalesce(sum(h.likes_this_hour), 0) AS BIGINT)
               AS prior_cumulative_likes
        FROM needed n LEFT JOIN hourly h ON h.subject_uri = n.subject_uri AND h.like_hour < n.target_hour
        GROUP BY ALL""",
    "valid_vectors": f"""
        SELECT at_uri, embedding FROM post_vectors
        WHERE len(embedding) = {DIM} AND at_uri IN (SELECT at_uri FROM sampled_posts)""",
    "emb_table": "SELECT at_uri, row_number() OVER (ORDER BY at_uri) - 1 AS emb_idx, embedding FROM valid_vectors",
    "joined_likes": """
        SELECT * FROM sampled_likes WHERE subject_uri IN (SELECT at_uri FROM emb_table)""",
    "verified_likes": f"""
        SELECT * FROM joined_likes
        WHERE did IN (SELECT did FROM joined_likes GROUP BY did HAVING count(*) >= {MIN_LIKES})""",
    "first_likes": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY did, subject_uri ORDER BY record_created_at) AS rn
                       FROM verified_likes) WHERE rn = 1""",
    "likes_ids": """
        SELECT l.did, l.subject_uri, l.record_created_at, l.split, l.like_hour_bucket,
               coalesce(p.prior_cumulative_likes, 0) AS prior_cumulative_likes, e.emb_idx,
               split_part(l.subject_uri, '@', 1) AS author_did
        FROM first_likes l JOIN emb_table e ON e.at_uri = l.subject_uri
        LEFT JOIN prior p ON p.subject_uri = l.subject_uri AND p.target_hour = l.like_hour_bucket""",
    "posts_ids": """
        SELECT s.*, CASE WHEN s.in_random_sample THEN coalesce(p.prior_cumulative_likes, 0) END
                    AS prior_cumulative_likes, e.emb_idx
        FROM sampled_posts s JOIN emb_table e USING (at_uri)
        LEFT JOIN prior p ON p.subject_uri = s.at_uri AND p.target_hour = s.negative_hour_bucket""",
    "exposures": """
        SELECT did AS author_did, 1 AS n_sampled, 0 AS n_liked FROM posts_ids
        WHERE in_random_sample AND split_window = 'train'
        UNION ALL SELECT author_did, 0, 1 FROM likes_ids WHERE split = 'train'""",
    "authors": f"""
        SELECT author_did, author_train_count, row_number() OVER (ORDER BY author_did) + 1 AS author_idx
        FROM (SELECT author_did, count(*) AS author_train_count FROM exposures GROUP BY author_did
              HAVING count(*) >= {AUTHOR_SUPPORT})""",
    "likes_core": "SELECT l.*, a.author_idx FROM likes_ids l LEFT JOIN authors a USING (author_did)",
    "posts_core": "SELECT p.*, a.author_idx FROM posts_ids p LEFT JOIN authors a ON a.author_did = p.did",
    "curve": """
        SELECT e.emb_idx, h.like_hour + INTERVAL 1 HOUR AS popularity_hour_bucket,
               CAST(sum(h.likes_this_hour) OVER (PARTITION BY e.emb_idx ORDER BY h.like_hour) AS BIGINT)
               AS prior_cumulative_likes
        FROM hourly h JOIN emb_table e ON e.at_uri = h.subject_uri
        WHERE h.subject_uri IN (SELECT subject_uri FROM likes_core)""",
    "user_hours": "SELECT DISTINCT split, did, like_hour_bucket FROM likes_core",
    "prior_pairs": """
        SELECT u.did, u.like_hour_bucket, l.emb_idx, l.author_idx, l.record_created_at,
               count(*) OVER (PARTITION BY u.did, u.like_hour_bucket) AS raw_prior_count,
               row_number() OVER (PARTITION BY u.did, u.like_hour_bucket
                                  ORDER BY l.record_created_at DESC, l.emb_idx DESC) AS pos
        FROM (SELECT DISTINCT did, like_hour_bucket FROM likes_core) u
        JOIN likes_core l ON l.did = u.did AND l.record_created_at < u.like_hour_bucket""",
    "history_entries": f"""
        SELECT p.*, coalesce((SELECT max(c.prior_cumulative_likes) FROM curve c
                              WHERE c.emb_idx = p.emb_idx AND c.popularity_hour_bucket <= p.like_hour_bucket), 0)
               AS prior_cumulative_likes,
               CAST(floor((epoch_us(p.like_hour_bucket) - epoch_us(p.record_created_at)) / 1000000.0) AS BIGINT)
               AS age_seconds
        FROM prior_pairs p WHERE p.pos <= {MAX_PRIOR}""",
    "history": """
        SELECT u.did, u.like_hour_bucket, coalesce(max(e.raw_prior_count), 0) AS raw_prior_count,
               count(e.pos) AS n_prior,
               coalesce(list(e.emb_idx ORDER BY e.pos) FILTER (e.pos IS NOT NULL), []) AS prior_emb_indices,
               coalesce(list(e.age_seconds ORDER BY e.pos) FILTER (e.pos IS NOT NULL), []) AS age_seconds,
               coalesce(list(e.prior_cumulative_likes ORDER BY e.pos) FILTER (e.pos IS NOT NULL), [])
                 AS prior_cumulative_likes,
               coalesce(list(e.author_idx ORDER BY e.pos) FILTER (e.pos IS NOT NULL), []) AS prior_author_indices
        FROM (SELECT DISTINCT did, like_hour_bucket FROM likes_core) u
        LEFT JOIN history_entries e USING (did, like_hour_bucket)
        GROUP BY u.did, u.like_hour_bucket""",
    "batched": f"""
        SELECT split, did, like_hour_bucket,
               (row_number() OVER (PARTITION BY split, like_hour_bucket
                                   ORDER BY md5('42:batch:0:' || did), did) - 1) // {BATCH} AS batch_id
        FROM user_hours""",
    "batch_likes": """
        SELECT b.split, b.like_hour_bucket, b.batch_id, b.did, l.subject_uri AS post_id, l.emb_idx,
               l.record_created_at, coalesce(l.author_idx, 1) AS author_idx,
               CAST(l.prior_cumulative_likes AS DOUBLE) AS prior_cumulative_likes
        FROM batched b JOIN likes_core l USING (split, did, like_hour_bucket)""",
    "batch_positives": """
        SELECT split, like_hour_bucket, batch_id, post_id, emb_idx, author_idx, prior_cumulative_likes
        FROM (SELECT *, row_number() OVER (PARTITION BY split, like_hour_bucket, batch_id, post_id
                ORDER BY record_created_at, emb_idx, prior_cumulative_likes, author_idx) AS rn FROM batch_likes)
        WHERE rn = 1""",
    "batch_negatives": f"""
        SELECT b.split, b.like_hour_bucket, b.batch_id, p.at_uri AS post_id, p.emb_idx,
               coalesce(p.author_idx, 1) AS author_idx,
               CAST(coalesce(p.prior_cumulative_likes, 0) AS DOUBLE) AS prior_cumulative_likes
        FROM (SELECT DISTINCT split, like_hour_bucket, batch_id, {SPLIT_WINDOW} AS w FROM batched) b
        JOIN posts_core p ON p.split_window = b.w AND p.negative_hour_bucket = b.like_hour_bucket
        WHERE p.in_random_sample
          AND NOT EXISTS (SELECT 1 FROM batch_positives q WHERE q.split = b.split
                          AND q.like_hour_bucket = b.like_hour_bucket AND q.batch_id = b.batch_id
                          AND q.post_id = p.at_uri)""",
    "candidates": """
        SELECT *, true AS from_likes FROM batch_positives
        UNION ALL SELECT *, false FROM batch_negatives""",
    "pairs": """
        SELECT c.*, b.did,
               CASE WHEN EXISTS (SELECT 1 FROM likes_core l WHERE l.split = b.split AND l.did = b.did
                     AND l.like_hour_bucket = b.like_hour_bucket AND l.subject_uri = c.post_id) THEN 1 ELSE 0 END
               AS label
        FROM batched b JOIN candidates c USING (split, like_hour_bucket, batch_id)""",
    "like_totals": "SELECT did, count(DISTINCT subject_uri) AS num_total_likes FROM likes_core GROUP BY did",
    # Popularity scorer: the prior likes of the candidate at the hour.
    "scores": """
        SELECT p.*, ln(1 + p.prior_cumulative_likes) AS score, least(h.n_prior, 20) AS num_embedding_likes,
               t.num_total_likes
        FROM pairs p JOIN history h USING (did, like_hour_bucket) JOIN like_totals t USING (did)""",
    "ranked": """
        SELECT *, row_number() OVER r AS rank, sum(label) OVER (r ROWS UNBOUNDED PRECEDING) AS hits,
               count(*) OVER g AS n, sum(label) OVER g AS p,
               count(*) OVER s AS n_down_to, sum(label) OVER s AS pos_down_to,
               count(*) OVER t AS n_same, sum(label) OVER t AS pos_same
        FROM scores
        WINDOW g AS (PARTITION BY split, like_hour_bucket, batch_id, did),
               r AS (PARTITION BY split, like_hour_bucket, batch_id, did ORDER BY score DESC, post_id),
               s AS (PARTITION BY split, like_hour_bucket, batch_id, did ORDER BY score DESC
                     RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               t AS (PARTITION BY split, like_hour_bucket, batch_id, did, score)""",
}


def row_metrics(source: str, keys: str, extra: str = "") -> str:
    """Ranking rows of a ranked table."""
    gains = []
    for k in TOP_KS:
        dcg = f"coalesce(sum(CASE WHEN label = 1 AND rank <= {k} THEN 1 / log2(rank + 1) END), 0)"
        ideal = f"list_sum(list_transform(range(1, CAST(least(max(p), {k}, max(n)) AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))"
        gains += [
            f"{dcg} AS dcg_at_{k}",
            f"CASE WHEN max(p) > 0 THEN {dcg} / {ideal} ELSE 0 END AS ndcg_at_{k}",
            f"CASE WHEN max(p) > 0 THEN count(*) FILTER (label = 1 AND rank <= {k}) / max(p) ELSE 0 END"
            f" AS recall_at_{k}",
        ]
    return f"""
        SELECT {keys}, {extra}
               count(*) AS candidate_count, CAST(max(p) AS BIGINT) AS positive_count,
               min(rank) FILTER (label = 1) AS positive_rank_min, avg(rank) FILTER (label = 1) AS positive_rank_mean,
               max(rank) FILTER (label = 1) AS positive_rank_max,
               avg(hits / rank) FILTER (label = 1) AS strict_average_precision,
               avg(pos_down_to / n_down_to) FILTER (label = 1) AS average_precision,
               CASE WHEN max(n) > max(p) THEN
                 avg(((n - p) - (n_down_to - pos_down_to) + 0.5 * (n_same - pos_same)) / (n - p)) FILTER (label = 1)
               END AS auc_roc,
               {', '.join(gains)}
        FROM {source} GROUP BY {keys}"""


CTES["ranking_rows"] = row_metrics(
    "ranked",
    "split, like_hour_bucket, batch_id, did",
    "max(num_embedding_likes) AS num_embedding_likes, max(num_total_likes) AS num_total_likes,",
)
# A like event scored by its hash, with the user's earlier likes as history.
CTES["predictions"] = f"""
    SELECT did, post_id, y_true, n_before AS num_embedding_likes,
           {uniform("md5('42:proba:' || did || ':' || post_id)")} AS y_pred_proba
    FROM (SELECT did, subject_uri AS post_id,
                 CAST('0x' || substr(md5('42:truth:' || did || ':' || subject_uri), 1, 8) AS BIGINT) % 2 AS y_true,
                 row_number() OVER (PARTITION BY did ORDER BY record_created_at, subject_uri) - 1 AS n_before
          FROM raw_likes)"""


def with_(select: str, **extra: str) -> str:
    """``select`` with every named expression it needs, directly or not, in front of it.

    ``extra`` adds expressions of this query alone.
    """
    known = {**CTES, **extra}
    done: list[str] = []

    def visit(sql: str) -> None:
        for name in known:
            if name not in done and re.search(rf"(FROM|JOIN)\s+{name}\b", sql):
                visit(known[name])
                if name not in done:
                    done.append(name)

    visit(select)
    if not done:
        return select
    parts = ",\n".join(f"{name} AS MATERIALIZED ({known[name]})" for name in done)
    return f"WITH {parts}\n{select}"
