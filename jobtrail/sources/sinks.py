"""Writers: ledger tables, date-partitioned logs, and XML responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with ``rows`` added; missing columns are NULL."""
    return table.unionByName(rows, allowMissingColumns=True)


def write_logs(lines: DataFrame, path: str, stamp: str = "stamp") -> None:
    """Store log lines under ``log_date=<first ten characters of the stamp>``.

    The rebalance keeps the lines of a date together in few files and lets adaptive execution
    split a date that holds far more lines than the others.
    """
    dated = lines.withColumn("log_date", F.substring(stamp, 1, 10))
    dated.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(path)


def read_logs(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """Stored lines of the dates ``since`` to ``until``; other dates are not opened."""
    logs = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return logs.withColumn("log_date", F.col("log_date").cast("string")).filter(
        F.col("log_date").between(since, until))


def to_response(columns: Sequence[str | Column], root: str = "response") -> Column:
    """One XML document per row; nest a struct for a second level. NULL fields are left out."""
    return F.to_xml(F.struct(*columns), {"rowTag": root})


def write_responses(df: DataFrame, path: str, root: str, row: str) -> None:
    """A list response of any length: one well-formed document ``<root><row/>..</root>`` per part file."""
    df.write.format("xml").option("rootTag", root).option("rowTag", row).option("declaration", "").save(path)
