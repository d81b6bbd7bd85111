"""Column expressions that parse ids, stamps and amounts. No shuffle, all code-generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C


def app_id_of(line: Column, strict: bool = False) -> Column:
    """Application id at the end of a submission line, NULL for any other line.

    ``strict`` keeps only ids whose number has exactly four digits.
    """
    is_id, appid = _trailing_id(line, strict)
    return F.when(is_id, appid)


def extract_app_ids(lines: DataFrame, strict: bool = False, line: str = "line") -> DataFrame:
    """Keep submission lines and replace the text by the id found in it."""
    is_id, appid = _trailing_id(F.col(line), strict)
    return lines.filter(is_id).withColumn("appid", appid).drop(line)


def _trailing_id(line: Column, strict: bool) -> tuple[Column, Column]:
    # A plain search finds the few submission lines and the last "application_" in them; the
    # pattern then only looks at what follows, from its first character.
    tail = F.substring_index(line, "application_", -1)
    digits = C.APP_ID_TAIL_STRICT if strict else C.APP_ID_TAIL
    return line.contains(C.SUBMIT_MARK) & tail.rlike(digits), F.concat(F.lit("application_"), tail)


def parse_app_id(appid: Column) -> Column:
    """Struct (cluster_ts, number) of an application id; all digits of the number count."""
    return F.struct(
        F.regexp_extract(appid, C.APP_ID_PARTS, 1).try_cast("bigint").alias("cluster_ts"),
        F.regexp_extract(appid, C.APP_ID_PARTS, 2).try_cast("bigint").alias("number"),
    )


def stamp_to_timestamp(stamp: Column, fmt: str = C.STAMP_FORMAT) -> Column:
    return F.try_to_timestamp(stamp, F.lit(fmt))


def timestamp_to_stamp(ts: Column, fmt: str = C.STAMP_FORMAT) -> Column:
    return F.date_format(ts, fmt)


def stamp_parts(df: DataFrame, stamp: str) -> DataFrame:
    """Add the parsed time, the date part (first ten characters) and the time part."""
    text = F.col(stamp)
    return df.withColumns({
        "stamp_ts": F.coalesce(stamp_to_timestamp(text), stamp_to_timestamp(text, C.STAMP_FORMAT_SECONDS)),
        "stamp_date": F.substring(text, 1, 10),
        "stamp_time": F.substring(text, 12, 64),
    })


def engine_of(opid: Column) -> Column:
    """Text before the first dot; NULL when there is no dot."""
    return F.when(opid.contains("."), F.substring_index(opid, ".", 1))


def engine_class(opid: Column) -> Column:
    """Which tracker follows the task: ``hive`` or ``yarn``."""
    return F.when(engine_of(opid) == C.HIVE_ENGINE, "hive").otherwise("yarn")


def parse_quota(quota: Column) -> Column:
    """Bytes of a quota such as ``10GB``; the unit is dropped unread, NULL if not a number."""
    amount = F.substring(quota, F.lit(1), F.length(quota) - 2)
    number = F.when(amount.rlike("^[+-]?[0-9]+$"), amount.try_cast("bigint"))
    return F.try_multiply(number, F.lit(C.BYTES_PER_GB).cast("bigint"))
