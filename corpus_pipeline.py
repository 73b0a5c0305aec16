"""Corpus pipeline: language ID, near-duplicates, decontamination, personal data, mixing, each stage stored for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import stages
from tracewell.llm.common import stored, table

STAGES = [
    ("language_id", stages.keep_known_language),
    ("near_duplicates", stages.keep_one_of_near_copies),
    ("decontamination", stages.drop_leaked),
    ("personal_data", stages.redact_personal_data),
    ("source_mix", stages.mix_sources),
]

#: No stage but the last is expressible in SQL: a trained classifier, XXH64 fingerprints, trained span scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
