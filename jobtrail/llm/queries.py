"""Registered queries over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm import (
    bpe, chat_format, decontaminate, filter_audit, language_id, near_dedup, periodic_runs, quality_rules, secret_scan,
    suffix_dedup, token_files, url_filter, weak_labels,
)
from jobtrail.llm.oracles import DECONTAMINATE, FILTER_AUDIT, NEAR_DUPLICATES, QUALITY_RULES, SUFFIX_DEDUP, URL_RULES
from jobtrail.operators.ordered import join_keys

TOKENIZER = "word_bpe_49k.json"
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(_table(spark, sf_dir, "documents"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.pack_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as plain lines, the first line of three in four turns marked in one of four styles."""
    name = F.initcap("role")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    mark = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(": "))).when(
        style == 2, F.concat(F.lit("["), name, F.lit("] "), F.lit(": "))).otherwise(
        F.concat(F.element_at(F.create_map(F.lit("user"), F.lit("Human"), F.lit("assistant"), F.lit("AI"),
                                           F.lit("system"), F.lit("System")), F.col("role")), F.lit(": ")))
    marked = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) > 0, F.coalesce(mark, F.lit(""))).otherwise(F.lit(""))
    body = F.concat(marked, F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", F.posexplode(F.split(body, "\n", -1)).alias("at", "line")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("at").cast("long").alias("at"), "role", "line")


def op9_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered turns of every conversation, and how many lines got the role they were written in."""
    lines = transcripts(_table(spark, sf_dir, "conversations"))
    parsed = chat_format.parse(lines, position=["turn", "at"])
    # Turns that repeat share positions; a line is right if its role was written there.
    truth = lines.filter(F.col("role").isin(*chat_format.ROLES)).groupBy("conv_id", "turn", "at").agg(F.collect_set("role").alias("_roles"))
    both = join_keys(parsed, truth, ["conv_id", "turn", "at"], "left")
    return both.groupBy("conv_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("opens").cast("long")).alias("n_turns"),
        F.sum(F.coalesce(F.array_contains("_roles", F.col("role")), F.lit(False)).cast("long")).alias("n_right"),
        F.sum(F.crc32(F.concat_ws("\x00", F.col("turn") * 100_000 + F.col("at"), "rendered"))).alias("rendered_crc32"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(_table(spark, sf_dir, "documents"), planted=True)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_weak_labels, op2_line_frequency, op3_url_rules, op4_repair_tokens, op5_ppm_language, op6_decontaminate,
        op7_near_duplicates, op8_bpe_automaton, op9_chat_roles, op10_secrets, op11_suffix_dedup,
        op12_periodic_runs, op13_filter_audit,
    )
}
ORACLE: dict[str, str] = {
    "op2_line_frequency": QUALITY_RULES,
    "op3_url_rules": URL_RULES,
    "op6_decontaminate": DECONTAMINATE,
    "op7_near_duplicates": NEAR_DUPLICATES,
    "op11_suffix_dedup": SUFFIX_DEDUP,
    "op13_filter_audit": FILTER_AUDIT,
}
