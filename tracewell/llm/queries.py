"""The ten queries, each an operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontam, lang_id, mixing, neighbours, pii, quality, secrets, simhash, substring, tokens
from tracewell.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address; their source stands for the host and source and language for the path."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_nearest_neighbours, op3_secret_scan, op4_simhash_dedup, op5_decontamination, op6_substring_dedup, op7_source_mix, op8_site_quality, op9_token_counts, op10_pii, pipeline)}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0
), starts AS (
  SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM words, (SELECT DISTINCT n FROM windows) k, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n
), found AS (
  SELECT row, s.n, i, id FROM starts s JOIN windows USING (n, win)
), hit AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) t(p) GROUP BY row
), ids AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, id FROM found) GROUP BY row
), lists AS (
  SELECT DISTINCT id, w[i:i + 9] AS x FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0
), numbered AS (
  SELECT x, row_number() OVER () AS win FROM (SELECT DISTINCT x FROM lists)
), terms AS (
  SELECT win, j, x[j] AS word, len(x) AS n FROM numbered, unnest(range(1, len(x) + 1)) t(j)
), posts AS (
  SELECT * FROM (SELECT row, p, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) t(p)) WHERE word IN (SELECT word FROM terms)
), freq AS (
  SELECT word, count(*) AS c FROM posts GROUP BY word
), rare AS (
  SELECT win, arg_min(j, (coalesce(c, 0), j)) AS j, arg_min(word, (coalesce(c, 0), j)) AS word FROM terms LEFT JOIN freq USING (word) GROUP BY win
), tried AS (
  SELECT DISTINCT row, win, p - j + d AS s FROM rare JOIN posts USING (word), unnest(range(-2, 3)) t(d)
), close AS (
  SELECT row, win FROM tried JOIN terms USING (win), unnest(range(-2, 3)) t(d) SEMI JOIN posts ON posts.row = tried.row AND posts.p = s + j + d AND posts.word = terms.word GROUP BY row, win, s, n HAVING count(DISTINCT j) = n
), near AS (
  SELECT row, count(DISTINCT id) AS n_near FROM close JOIN numbered USING (win) JOIN lists USING (x) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM words LEFT JOIN hit USING (row) LEFT JOIN ids USING (row) LEFT JOIN near USING (row)""",
    "op6_substring_dedup": r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT row, i, array_to_string(w[i:i + 34], ' ') AS win FROM words, unnest(range(1, len(w) - 33)) t(i) WHERE len(w) >= 35
), again AS (
  SELECT row, i AS p, i FROM starts WHERE win IN (SELECT win FROM starts GROUP BY win HAVING count(*) > 1)
), places AS (
  SELECT row, p, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) t(p)
), covered AS (
  SELECT row, p, word, max(i) OVER (PARTITION BY row ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS cover FROM places LEFT JOIN again USING (row, p)
), kept AS (
  SELECT row, count(cover) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE cover IS NULL) AS text FROM covered GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (row)""",
}
