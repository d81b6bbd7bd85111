"""Registering, updating and deleting operators and functions, a whole batch at a time.

Every row gets ``reason``: empty when the request passes, otherwise the first check that
rejects it. Checks run in the order a single request would meet them. Within a batch the
requests count as arriving in ``order``: once a request for a name passes, later ones for the
same name meet an existing name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C
from jobtrail.operators.capacity import admission
from jobtrail.operators.keys import apply_deletes, apply_updates, mark_existing
from jobtrail.operators.packages import package_check, submit_jar_check
from jobtrail.plans.validation import first_reason, rule
from jobtrail.session import stage


def _after_first_clean(df: DataFrame, key: str, order: str, clean: Column) -> DataFrame:
    """Add ``_repeat``: an earlier row of the same key already passed every check."""
    first = df.filter(clean & F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return (
        df.join(first, key, "left")
        .withColumn("_repeat", F.coalesce(F.col(order) > F.col("_first"), F.lit(False)))
        .drop("_first")
    )


def _package_reasons(df: DataFrame, entries: DataFrame, script_lines: DataFrame) -> DataFrame:
    """Add ``_package``: why the package of the operator is refused, empty when it is fine."""
    # Packages are judged without asking for whom, so the requests are parsed for one branch only.
    complete = package_check(entries).select("opid", "complete")
    submits = submit_jar_check(entries, script_lines).select("opid", "submits")
    reason = first_reason(
        rule(~F.coalesce("complete", F.lit(False)), F.format_string(C.ZIP_INCOMPLETE, F.col("opid"))),
        rule((F.col("enginename") == C.SINGLE_MACHINE_ENGINE) & ~F.coalesce("submits", F.lit(False)),
             C.SUBMIT_JAR_REQUIRED),
    )
    return (
        df.join(complete, "opid", "left").join(submits, "opid", "left")
        .withColumn("_package", reason).drop("complete", "submits")
    )


def register_operators(requests: DataFrame, registry: DataFrame, entries: DataFrame,
                       script_lines: DataFrame, order: str) -> DataFrame:
    """Judge validated operator requests: rules, name, package, submit jar, lengths."""
    df = mark_existing(requests, registry, "opid", "_known")
    # Judged rows feed two branches; staging parses every document once.
    df = stage(_package_reasons(df, entries, script_lines), "judged")
    clean = (F.col("error") == "") & ~F.col("_known") & (F.col("_package") == "") & (F.col("error_length") == "")
    df = _after_first_clean(df, "opid", order, clean)
    return df.withColumn("reason", first_reason(
        F.col("error"),
        rule(F.col("_known") | F.col("_repeat"), F.format_string(C.OPID_EXISTS, F.col("opid"))),
        F.col("_package"),
        F.col("error_length"),
    )).drop("_known", "_repeat", "_package")


def judge_operator_updates(requests: DataFrame, registry: DataFrame, entries: DataFrame,
                           script_lines: DataFrame) -> DataFrame:
    """Judge validated operator updates: the operator must exist, then rules, package, lengths."""
    df = mark_existing(requests, registry, "opid", "_known")
    df = _package_reasons(df, entries, script_lines)
    return df.withColumn("reason", first_reason(
        rule(~F.col("_known"), F.format_string(C.OPID_UNKNOWN, F.col("opid"))),
        F.col("error"),
        F.col("_package"),
        F.col("error_length"),
    )).drop("_known", "_package")


def update_operators(registry: DataFrame, judged: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """Registry after the accepted updates; the latest accepted update of an operator wins."""
    return apply_updates(registry, accepted(judged), "opid", cols, [order])


def judge_deletes(requests: DataFrame, registry: DataFrame, key: str, message: str) -> DataFrame:
    df = mark_existing(requests, registry, key, "_known")
    return df.withColumn("reason", first_reason(
        rule(~F.col("_known"), F.format_string(message, F.col(key))))).drop("_known")


def delete_registered(registry: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    return apply_deletes(registry, accepted(judged), key)


def udf_conflicts(batch: DataFrame, registry: DataFrame, metastore: DataFrame) -> DataFrame:
    """Add ``name`` (lower case) and the ``conflict`` it meets: system, registered, metastore or none.

    The reserved names are a short fixed list, tested by a constant set; registry and metastore
    join on the name and are broadcast only if their measured size allows.
    """
    df = batch.withColumn("name", F.lower("udfname"))
    known = registry.select(F.lower("udfname").alias("name")).distinct().withColumn("_known", F.lit(True))
    meta = metastore.select(F.lower("func_name").alias("name")).distinct().withColumn("_meta", F.lit(True))
    return (
        df.join(known, "name", "left").join(meta, "name", "left")
        .withColumn("conflict", F.when(F.col("name").isin(*C.SYSTEM_FUNCTIONS), "system")
                    .when(F.col("_known"), "registered").when(F.col("_meta"), "metastore").otherwise(""))
        .drop("_known", "_meta")
    )


def register_udfs(requests: DataFrame, registry: DataFrame, metastore: DataFrame, order: str) -> DataFrame:
    """Judge validated function requests: required fields, name conflicts, lengths."""
    df = stage(udf_conflicts(requests, registry, metastore), "judged")
    clean = (F.col("error") == "") & (F.col("conflict") == "") & (F.col("error_length") == "")
    df = _after_first_clean(df, "name", order, clean)
    name = F.col("name")
    return df.withColumn("reason", first_reason(
        F.col("error"),
        rule(F.col("conflict") == "system", F.format_string(C.UDF_SYSTEM, name)),
        rule((F.col("conflict") == "registered") | F.col("_repeat"), F.format_string(C.UDF_EXISTS, name)),
        rule(F.col("conflict") == "metastore", F.format_string(C.UDF_IN_METASTORE, name)),
        F.col("error_length"),
    )).drop("_repeat")


def judge_udf_updates(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Judge validated function updates: the descriptor first, then the name must be registered."""
    df = mark_existing(requests.withColumn("udfname", F.lower("udfname")),
                       registry.withColumn("udfname", F.lower("udfname")), "udfname", "_known")
    return df.withColumn("reason", first_reason(
        F.col("error"),
        rule(~F.col("_known"), F.format_string(C.UDF_UNKNOWN_UPDATE, F.col("udfname"))),
    )).drop("_known")


def judge_queues(requests: DataFrame, queues: DataFrame, properties: DataFrame, total_memory: Column,
                 update: bool = False) -> DataFrame:
    """Judge validated queue requests: rules, the queue name, then whether the default queue can pay.

    A new queue must not exist yet and an updated one must exist. Requests are independent.
    """
    known = queues.select(F.col("queue_name").alias("name"))
    df = mark_existing(requests, known, "name", "_known")
    df = admission(df.withColumn("queue_name", F.col("name")), properties, total_memory, update)
    wrong_name = (
        rule(~F.col("_known"), F.format_string(C.QUEUE_UNKNOWN, F.col("name"))) if update
        else rule(F.col("_known"), F.format_string(C.QUEUE_EXISTS, F.col("name")))
    )
    return df.withColumn("reason", first_reason(
        F.col("error"), wrong_name,
        rule(~F.coalesce("admitted", F.lit(False)), C.NOT_ENOUGH_MEMORY),
    )).drop("_known", "queue_name")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason") == "")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason") != "")
