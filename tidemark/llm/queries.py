"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bloom_lm, bpe, conversation_repair, decontamination, image_copies, lexical_search, licenses, packing, pii, simhash, substring_dedup, token_files, toxicity
from tidemark.llm.rows import documents

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def image_copy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables hold no pictures: one is drawn of each vector, and an edited copy of each query (ids by 100: vectors by 50).
    images = image_copies.pictures_of(table(spark, sf_dir, "embeddings"), every=50)
    return image_copies.find_copies(images, queries="image_id % 100 = 0")


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    # This vocabulary has 49,408 ids; it drops white space and splits there first.
    files = token_files.write_token_files(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, by_word=True, vocabulary=49_408
    )
    return token_files.read_documents(spark, files)


def substring_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold(F.col("doc_id"), 7) == 2
    return bloom_lm.score_documents(documents(spark, sf_dir).withColumn("held_out", held_out))


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def conversation_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audit_of_damaged(table(spark, sf_dir, "conversations"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer), tokenizer)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": toxicity_scores,
    "op2_license_scan": license_scan,
    "op3_image_copies": image_copy_search,
    "op4_token_files": token_output,
    "op5_substring_dedup": substring_removal,
    "op6_benchmark_decontamination": benchmark_decontamination,
    "op7_personal_data": personal_data,
    "op8_bloom_language_model": language_model_scores,
    "op9_simhash_near_duplicates": simhash_components,
    "op10_best_fit_packing": best_fit_packing,
    "op11_conversation_repair": conversation_repairs,
    "op12_token_ids": token_ids,
    "op13_ranked_search": ranked_search,
}

#: Words of whole texts, in SQL.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def _substring_oracle(size: int) -> str:
    return f"""
    WITH d AS (SELECT doc_id, {_SPACED.format("text")} AS w FROM documents),
    windows AS (SELECT doc_id, s, array_to_string(w[s : s + {size - 1}], ' ') AS g
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS s FROM d WHERE len(w) >= {size})),
    repeated AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, p FROM
             (SELECT doc_id, unnest(range(s, s + {size})) AS p FROM windows SEMI JOIN repeated USING (g))),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
             FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(body, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)"""


def _decontamination_oracle(size: int) -> str:
    return f"""
    WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("text"))} AS w FROM documents),
    i AS (SELECT item_id, w, least({size}, len(w)) AS k
          FROM (SELECT item_id, {_ALNUM.format(_LOWER.format("text"))} AS w FROM benchmark) WHERE len(w) > 0),
    tests AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g
              FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
    lengths AS (SELECT list(DISTINCT k) AS ks FROM tests),
    places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
           FROM (SELECT doc_id, w, unnest((SELECT ks FROM lengths)) AS k FROM d) WHERE len(w) >= k),
    hits AS (SELECT doc_id, s, p.k, item_id FROM places p JOIN tests t ON p.k = t.k AND array_to_string(w[s : s + p.k - 1], ' ') = g),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _search_oracle(k: int) -> str:
    return f"""
    WITH d AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n
               FROM (SELECT doc_id, {_ALNUM.format(_LOWER.format("text"))} AS w FROM documents) WHERE len(w) > 0),
    size AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM d),
    i AS (SELECT item_id, term, count(*) AS times
          FROM (SELECT item_id, unnest({_ALNUM.format(_LOWER.format("text"))}) AS term FROM benchmark) GROUP BY ALL),
    tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d)
           WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    weight AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
               FROM tf, size GROUP BY term, documents),
    scored AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf)
                   // (1000 * tf + 8 * (100 - 75 + (75 * n * documents) // size.terms)))) AS BIGINT) AS score
               FROM tf JOIN weight USING (term) JOIN i USING (term), size GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                      doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= {k}"""


ORACLES: dict[str, str] = {
    "op5_substring_dedup": _substring_oracle(substring_dedup.WINDOW),
    "op6_benchmark_decontamination": _decontamination_oracle(decontamination.WINDOW),
    "op2_license_scan": licenses.oracle(),
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op13_ranked_search": _search_oracle(lexical_search.K),
}
