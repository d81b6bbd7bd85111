"""Request rules as columns: every row is judged in one projection, without a shuffle.

Each function adds ``errors`` (all broken rules in the order they fire) and ``error`` (the one
that is reported; empty when the request is fine). Task, function and queue requests report
the last broken rule, the others the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C
from jobtrail.functions.parsing import engine_of, parse_quota
from jobtrail.sources.documents import has_property, named


def too_long(value: Column, name: str, limit: int) -> Column:
    return F.when(F.length(value) > limit, F.lit(C.TOO_LONG.format(name=name, limit=limit)))


def rule(broken: Column, message: str | Column) -> Column:
    return F.when(broken, F.lit(message) if isinstance(message, str) else message)


def _firing(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _report(df: DataFrame, errors: Column, last: bool, suffix: str = "") -> DataFrame:
    df = df.withColumn(f"errors{suffix}", errors)
    pick = F.try_element_at(F.col(f"errors{suffix}"), F.lit(-1 if last else 1))
    return df.withColumn(f"error{suffix}", F.coalesce(pick, F.lit("")))


def validate_tasks(requests: DataFrame) -> DataFrame:
    """Task requests from ``parse_requests(.., "task")``; the last broken rule is reported."""
    p = F.col("properties")

    def property_error(item: Column) -> Column:
        name, value = item["_name"], item["_value"]
        cases = []
        for prop in ("queueName", "userName", "processId"):
            error = F.when(F.length(value) > C.MAX_PROPERTY,
                           C.TOO_LONG.format(name=prop, limit=C.MAX_PROPERTY))
            if prop != "queueName":
                error = error.when(value == "", C.EMPTY_PROPERTY.format(name=prop))
            cases.append((prop, error))
        cases.append(("tempHdfsBasePath", rule(value == "", C.EMPTY_PROPERTY.format(name="tempHdfsBasePath"))))
        return F.coalesce(*[F.when(name == prop, error) for prop, error in cases])

    instance = too_long(F.col("jobinstanceid"), "jobInstanceId", C.MAX_PROPERTY)
    missing = _firing(
        rule(F.col("jobinstanceid").isNull(), C.NO_JOB_INSTANCE),
        rule(~has_property(p, "userName"), C.NO_USER),
        rule(~has_property(p, "processId"), C.NO_PROCESS),
        rule(~has_property(p, "tempHdfsBasePath"), C.NO_BASE_PATH),
    )
    full = F.concat(_firing(instance), F.array_compact(F.transform(p, property_error)), missing)
    errors = (
        F.when(F.col("malformed"), F.array(F.lit(C.MALFORMED)))
        .when(~F.col("has_context"), _firing(instance, F.lit(C.NO_CONTEXT)))
        .otherwise(full)
    )
    return _report(requests, errors, last=True).withColumns({
        "queuename": F.when(has_property(p, "queueName"), named(p, "queueName")).otherwise(C.DEFAULT_QUEUE),
        "username": named(p, "userName"),
        "processid": named(p, "processId"),
        "base_path": named(p, "tempHdfsBasePath"),
    }).drop("properties", "has_context", "malformed")


OPERATOR_FIELDS = ("opid", "version", "biztype", "provider", "opjarpath", "devlang", "descriptor", "instruction")


def validate_operators(requests: DataFrame, paths: DataFrame | None = None, update: bool = False) -> DataFrame:
    """Operator requests from ``parse_requests(.., "operator")``.

    Adds ``error`` (parse rules, the first in document order) and ``error_length`` (field
    lengths, the first in fixed order), which registration reports at a later stage.
    ``paths`` lists the package files that exist (column ``path``). With ``update`` the opid
    comes from the column of that name and its rules do not apply.
    """
    p = F.col("properties")
    fields = {f: named(p, f) for f in OPERATOR_FIELDS if not (update and f == "opid")}
    df = requests.withColumns(fields).withColumn("enginename", engine_of(F.col("opid")))
    if paths is None:
        df = df.withColumn("_zip", F.lit(True))
    else:
        known = paths.select(F.col("path").alias("opjarpath")).distinct().withColumn("_zip", F.lit(True))
        df = df.join(known, "opjarpath", "left").withColumn("_zip", F.coalesce("_zip", F.lit(False)))

    def property_error(item: Column, zip_exists: Column) -> Column:
        name, value = item["_name"], item["_value"]
        opid = (
            F.when(value == "", C.OPID_NULL)
            .when(value.contains(" "), C.OPID_SPACE)
            .when(~value.contains("."), C.OPID_NO_DOT)
            .when(~F.substring_index(value, ".", 1).isin(*C.ENGINES), C.OPID_ENGINE)
        )
        jar = F.when(value == "", C.OPJARPATH_NULL).when(
            ~zip_exists, F.format_string(C.ZIP_MISSING, value))
        cases = [F.when(name == "opjarpath", jar)]
        if not update:
            cases.append(F.when(name == "opid", opid))
        return F.coalesce(*cases)

    missing = [rule(~has_property(p, "opjarpath"), C.OPJARPATH_NULL)]
    if not update:
        missing.insert(0, rule(~has_property(p, "opid"), C.OPID_NULL))
    zip_exists = F.col("_zip")
    errors = F.when(F.col("malformed"), F.array(F.lit(C.MALFORMED))).otherwise(
        F.concat(F.array_compact(F.transform(p, lambda i: property_error(i, zip_exists))), _firing(*missing))
    )
    lengths = _firing(
        *[too_long(F.col(f), f, C.MAX_FIELD)
          for f in ("opid", "devlang", "version", "provider", "enginename", "opjarpath")],
        *[too_long(F.col(f), f, C.MAX_TEXT) for f in ("descriptor", "instruction")],
    )
    df = _report(df, errors, last=False)
    df = _report(df, lengths, last=False, suffix="_length")
    return df.drop("properties", "malformed", "_zip")


def validate_udfs(requests: DataFrame) -> DataFrame:
    """Function requests from ``parse_requests(.., "udf")``: five fields required, last missing
    one reported; ``error_length`` holds the first over-long field."""
    fields = ("udfname", "classname", "jarname", "descriptor", "author")
    missing = _firing(*[rule(F.col(f).isNull(), C.FIELD_NULL.format(name=f)) for f in fields])
    errors = F.when(F.col("malformed"), F.array(F.lit(C.MALFORMED))).otherwise(missing)
    lengths = _firing(
        *[too_long(F.col(f), f, C.MAX_FIELD) for f in ("udfname", "classname", "jarname", "author")],
        too_long(F.col("descriptor"), "descriptor", C.MAX_TEXT),
    )
    df = _report(requests, errors, last=True)
    return _report(df, lengths, last=False, suffix="_length").drop("malformed")


def validate_udf_updates(requests: DataFrame) -> DataFrame:
    """Function updates from ``parse_requests(.., "udf_update")``."""
    errors = _firing(
        rule(F.col("malformed"), C.MALFORMED),
        rule(F.col("descriptor").isNull(), C.FIELD_NULL.format(name="descriptor")),
        too_long(F.col("descriptor"), "descriptor", C.MAX_TEXT),
    )
    return _report(requests, errors, last=False).drop("malformed")


def validate_quotas(requests: DataFrame) -> DataFrame:
    """Quota requests from ``parse_requests(.., "quota")``: present, a number, within the cap."""
    amount = F.substring(F.col("quota"), F.lit(1), F.length("quota") - 2)
    number = F.coalesce(amount.rlike("^[+-]?[0-9]+$"), F.lit(False))
    df = requests.withColumn("quota_bytes", parse_quota(F.col("quota")))
    small = F.coalesce(F.col("quota_bytes") <= C.MAX_QUOTA_BYTES, F.lit(False))
    errors = _firing(
        rule(F.col("malformed"), C.MALFORMED),
        rule(F.col("quota").isNull(), C.QUOTA_NULL),
        rule(F.col("quota").isNotNull() & ~number, C.QUOTA_NOT_NUMBER),
        rule(number & ~small, C.QUOTA_TOO_LARGE),
    )
    df = _report(df, errors, last=False).drop("malformed")
    return df.withColumn("quota_bytes", F.when(F.col("error") == "", F.col("quota_bytes")))


def validate_queues(requests: DataFrame) -> DataFrame:
    """Queue requests from ``parse_requests(.., "queue")``; a missing memtotal outranks the name."""
    errors = _firing(
        rule(F.col("name").isNull(), C.QUEUE_NAME_MISSING),
        rule(F.col("memtotal").isNull(), C.MEMTOTAL_MISSING),
        rule(F.col("malformed"), C.MALFORMED),
    )
    df = requests.withColumn("userlimitfactor", F.coalesce("userlimitfactor", F.lit("1.0")))
    return _report(df, errors, last=True).drop("malformed")


def first_reason(*reasons: Column) -> Column:
    """First non-empty reason, empty when all pass."""
    return reduce(lambda rest, r: F.when(F.coalesce(r, F.lit("")) != "", r).otherwise(rest),
                  reversed(reasons), F.lit(""))
