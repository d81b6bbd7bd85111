"""Named queries and the SQL that answers the same question independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobtrail import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Attribute access to the test tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        refs = {r: getattr(self, r) for r in fixtures.references(text) if r not in frames}
        return self.spark.sql(text, **refs, **frames)


def query(name: str, sql: str | None = None, views: str = "", extra: str = ""):
    """Register a query. ``views`` are the derived views its SQL reads; ``extra`` adds more."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            head = fixtures.ctes(*views.split()) if views else ""
            if extra:
                head = f"{head},\n{extra}" if head else f"with {extra}"
            ORACLE[name] = f"{head}\n{sql.strip()}"
        return fn

    return register
