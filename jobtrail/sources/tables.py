"""Relational tables, and the description of catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtrail.functions.statistics import compute_stats


def jdbc_options(url: str, table: str, key: str | None = None, lower: int = 0, upper: int = 0,
                 partitions: int = 1, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options; with a numeric ``key`` the scan runs as ``partitions`` range queries."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if key:
        options.update(partitionColumn=key, lowerBound=str(lower), upperBound=str(upper),
                       numPartitions=str(partitions))
    return options


def read_ledger(spark: SparkSession, source: str, **options) -> DataFrame:
    """A ledger table from a JDBC url (``table=`` required) or a path of parquet files."""
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(**jdbc_options(source, **options)).load()
    return spark.read.parquet(source)


def list_columns(spark: SparkSession, table: str) -> DataFrame:
    """(pos, name, type, ispart) of a catalog table or view: data columns first."""
    columns = spark.catalog.listColumns(table)
    ranked = sorted(enumerate(columns), key=lambda c: (c[1].isPartition, c[0]))
    rows = [(i, c.name, c.dataType, "TRUE" if c.isPartition else "FALSE") for i, (_, c) in enumerate(ranked)]
    return spark.createDataFrame(rows, "pos int, name string, type string, ispart string")


def describe_table(spark: SparkSession, table: str, ndv: str | None = "approx") -> DataFrame:
    """Columns of a table with their statistics, computed in one pass over the table.

    Every column is listed; nested and binary ones have no statistics.
    """
    stats = compute_stats(spark.table(table), ndv=ndv)
    return list_columns(spark, table).join(stats.withColumnRenamed("column", "name"), "name", "left").orderBy("pos")


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
