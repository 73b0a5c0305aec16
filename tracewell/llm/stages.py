"""Stages of the corpus pipeline: language ID, near-duplicates, decontamination, personal data, mixing.

Each takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of docs (the last adds `taken`, the
words that the mix takes). Rows alike in id and text are decided alike. Null, empty and blank texts have no known
language, so the first stage rejects them; later stages take them all the same. An empty table gives an empty result, and
columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontam, lang_id, mixing, pii, simhash
from tracewell.llm.common import stored, table

MIN_LANG_SCORE = 0.4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is predicted with a calibrated probability of MIN_LANG_SCORE or more."""
    return lang_id.accepted(docs, min_score=MIN_LANG_SCORE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the document with the smallest id."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window, found by exact phrases; null and empty texts have none."""
    keyed = _keyed(docs, "doc_id", "text")
    found = decontam.find_leaks(keyed.select("key", F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"), slop=0, id_col="key")
    leaked = stored(found.filter("contaminated").select(F.col("doc_id").alias("key")).distinct(), "leaked")
    return keyed.join(leaked.hint("shuffle_hash"), "key", "left_anti").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text, and a null text has no n_chars."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, and how many in `taken`, in place of any such column; empty ones are not taken."""
    docs = docs.drop("taken")
    keyed = _keyed(docs, "doc_id", "text", "source")
    flat = keyed.select("key", F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    taken = mixing.mix(flat, id_col="key").filter("taken > 0").select(F.col("doc_id").alias("key"), "taken").distinct()
    return keyed.join(taken.hint("shuffle_hash"), "key").select("row.*", "taken")


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """(key, row): a hash of the columns, and the whole row as one struct, so that no name of docs can clash."""
    return docs.select(F.xxhash64(*columns).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
