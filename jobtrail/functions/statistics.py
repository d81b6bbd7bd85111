"""Column statistics and bitmap aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values whose distinct ones one task collects before the shuffle.
VALUES_A_TASK = 1_000_000
_SCALAR = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def compute_stats(df: DataFrame, cols: Sequence[str] | None = None, ndv: str | None = "approx") -> DataFrame:
    """Count, nulls, min, max, average and distinct values of each column, one row per column.

    All columns share one aggregation pass with map-side combine. ``ndv`` is ``approx`` (a
    fixed-size sketch per column), ``exact`` (shuffles the distinct values of every column, see
    :func:`distinct_values`) or None. Minimum and maximum are rendered as text; the average is NULL for non-numbers.
    """
    fields = [f for f in df.schema.fields if (cols is None or f.name in cols) and isinstance(f.dataType, _SCALAR)]
    distinct = F.approx_count_distinct if ndv == "approx" else None
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, T.NumericType)
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.isNull()).alias(f"z{i}"),
            F.min(c).cast("string").alias(f"lo{i}"),
            F.max(c).cast("string").alias(f"hi{i}"),
            (F.avg(c).cast("double") if number else F.lit(None).cast("double")).alias(f"av{i}"),
            (distinct(c) if distinct else F.lit(None).cast("bigint")).alias(f"nd{i}"),
        ]
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"z{i}").alias("nulls"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"av{i}").alias("avg"),
            F.col(f"nd{i}").alias("ndv"),
        )
        for i, f in enumerate(fields)
    ]
    stats = df.agg(*aggs).select(F.inline(F.array(*rows)))
    if ndv != "exact":
        return stats
    return stats.drop("ndv").join(distinct_values(df, fields), "column", "left").withColumn("ndv", F.coalesce("ndv", F.lit(0)))


def distinct_values(df: DataFrame, fields: Sequence[T.StructField], values_a_task: int = VALUES_A_TASK) -> DataFrame:
    """Exact number of distinct values of each column, NULL not counted, as (column, ndv).

    Columns become rows (column, value). The rows of the table are dealt by their hash to as many tasks as their
    number asks for, so what a task collects before the shuffle stays bounded however the files are cut.
    """
    def value(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)  # zero has two signs
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)  # local times repeat when clocks go back
        return c.cast("string")

    if not fields:
        return df.sparkSession.createDataFrame([], "column string, ndv bigint")
    names = [F.col(f"`{f.name}`") for f in fields]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * len(fields) // values_a_task))
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), value(f).alias("value")) for f in fields])
    values = df.select(*names).repartition(tasks, F.xxhash64(*names)).select(F.inline(pairs))
    return values.distinct().groupBy("column").agg(F.count("value").alias("ndv"))


def bitmap_build(df: DataFrame, position: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of a non-negative integer column, one per (keys, bucket of 32768 positions)."""
    return df.groupBy(*keys, F.bitmap_bucket_number(position).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bitmap"))


def bitmap_or(bitmaps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Union of the bitmaps that share keys and bucket."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_and(bitmaps: DataFrame, member: str, members: int, keys: Sequence[str] = ()) -> DataFrame:
    """Intersection over ``members`` distinct values of ``member``.

    A bucket that some member lacks is empty there, so only complete buckets survive.
    """
    # One bitmap per member and bucket first, so that counting rows counts members.
    merged = bitmap_or(bitmaps, [*keys, member]).groupBy(*keys, "bucket").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("_members"))
    return merged.filter(F.col("_members") == members).drop("_members")


def bitmap_cardinality(bitmaps: DataFrame, keys: Sequence[str] = (), out: str = "n") -> DataFrame:
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(out))


def bitmap_is_empty(bitmap: Column) -> Column:
    return F.bitmap_count(bitmap) == 0
