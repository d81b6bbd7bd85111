"""URL rules matched by hashed host-suffix and path-prefix expressions.

A rule is a host and a path prefix written together (``example.org/es/``). It fits its host, all
subdomains, and every path that starts with its path. Each distinct (host, path) is expanded into
its host suffixes times the path prefixes whose lengths occur among the rules; expressions meet
rules by an equi-join on the first 32 bits of their SHA-256, and a hit counts only when the full
digest agrees. The longest rule wins; between equally long ones the longer host, then ``block``.

Defined cases: a NULL url or one without ``://`` has an empty host and path and meets no rule;
without a rule the verdict is ``allow``; rules with a NULL part are ignored, repeated rules count once;
an empty rule table allows everything; repeated pages are judged each. Further columns of the input
are not touched and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm.texts import columns

#: Parts that a popular expression or url is dealt to.
SALTS = 16
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as (verdict, expression), as a table."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])
    return spark.range(1).select(F.explode(rows).alias("_r")).select("_r.*")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digests(expression: Column) -> tuple[Column, Column]:
    full = F.sha2(expression, 256)
    return F.substring(full, 1, 8).alias("_short"), full.alias("_full")


def compiled(rules: DataFrame, verdict: str = "verdict", rule: str = "rule") -> DataFrame:
    table = columns(rules, _verdict=verdict, _rule=rule).dropna().withColumns({
        "_host": F.translate(F.substring_index("_rule", "/", 1), _UPPER, _LOWER),
        "_path": F.expr("substring(_rule, length(substring_index(_rule, '/', 1)) + 1)"),
    })
    best = table.groupBy("_host", "_path").agg(
        F.max("_verdict").alias("_verdict"), F.max_by("_rule", F.struct("_verdict", "_rule")).alias("_rule"))
    return best.select("*", *_digests(F.concat("_host", "_path")))


def _expressions(urls: DataFrame, lengths: Column) -> DataFrame:
    """Distinct hosts and paths as rows of hashed expressions."""
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(1 << 30)), "."))
    prefixes = F.filter("_all", lambda n: n <= F.length("_path"))
    split = urls.filter("_host <> ''").withColumn("_all", lengths).select(
        "_host", "_path", F.explode(suffixes).alias("_suffix"), prefixes.alias("_lengths"))
    split = split.select("_host", "_path", "_suffix", F.explode("_lengths").alias("_n"))
    return split.select(
        "_host", "_path", *_digests(F.concat("_suffix", F.expr("substring(_path, 1, _n)"))))


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               salts: int = SALTS) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    rows = columns(pages, _id=page_id, _url=url).select(
        "_id", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    table = compiled(rules)
    # At most one entry per length a path can have; a scalar subquery, not a join.
    lengths = F.coalesce(table.agg(F.collect_set(F.length("_path"))).scalar(), F.array().cast("array<int>"))
    asked = _expressions(rows.select("_host", "_path").distinct(), lengths).withColumn(
        "_salt", F.pmod(F.xxhash64("_host", "_path"), F.lit(salts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    known = table.select(
        "_short", F.col("_full").alias("_rule_full"), "_rule", "_verdict",
        F.length("_host").alias("_rule_host"), every)
    rank = F.struct(F.length("_rule").alias("l"), F.col("_rule_host").alias("h"), F.col("_verdict").alias("v"))
    decided = (
        asked.join(known, ["_short", "_salt"]).filter("_full = _rule_full")
        .groupBy("_host", "_path").agg(F.max_by(F.struct("_rule", "_verdict"), rank).alias("_best"))
    )
    # One url may be a third of all pages: its verdict is dealt to several parts.
    spread = rows.withColumn("_salt", F.pmod(F.coalesce(F.xxhash64("_id"), F.lit(0)), F.lit(salts)).cast("int"))
    return spread.join(decided.select("*", every), ["_host", "_path", "_salt"], "left").select(
        F.col("_id").alias(page_id), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best._rule").alias("rule"),
        F.coalesce("_best._verdict", F.lit(DEFAULT)).alias("verdict"))
