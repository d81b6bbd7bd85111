"""From raw documents to token ids, in five stages over whole tables.

Every stage takes the documents that its predecessor kept, and its result is written as Parquet in
the shared folder and read again, which cuts lineage and survives lost executors. A document that a
stage rejects is gone for the later ones; masked secrets stay masked.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobtrail.llm.bpe import round_trip
from jobtrail.llm.decontaminate import decontaminated
from jobtrail.llm.near_dedup import deduplicated
from jobtrail.llm.quality_rules import clean
from jobtrail.llm.secret_scan import redact
from jobtrail.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
#: Percent of common word shingles from which documents are near copies.
SIMILARITY = 85


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents share."""
    return clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return deduplicated(docs, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the decoded text."""
    return round_trip(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

#: The last stage is a tokenizer, which SQL cannot express; a brute-force version tests the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
