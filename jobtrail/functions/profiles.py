"""Column profiles that are kept per part of a table and merged.

A profile of a part is one row: for every column its counts, typed bounds, sum and a HyperLogLog
sketch of its values. Profiles of parts merge to that of the whole, so a new part is profiled alone and
the rest of the table is not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logarithm of the number of sketch buckets: 2^16 estimate within about 1.2 percent in 99 of 100 cases.
SKETCH = 16
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.VariantType)


def _plain(field: T.StructField) -> bool:
    return not isinstance(field.dataType, _NESTED)


def profile_parts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per part of ``df`` (per value of ``by``), in the form that ``merge_profiles`` takes.

    All columns share one aggregation with map-side combine. Nested and binary columns have counts only.
    """
    aggs: list[Column] = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.isNull()).alias(f"z{i}")]
        if _plain(f):
            number = isinstance(f.dataType, T.NumericType)
            whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                     (F.sum(c.cast("double")) if number else F.lit(None).cast("double")).alias(f"su{i}"),
                     F.hll_sketch_agg(c.cast("bigint" if whole else "string"), F.lit(SKETCH)).alias(f"sk{i}")]
    return df.groupBy(*by).agg(*aggs)


def merge_profiles(parts: DataFrame, schema: T.StructType) -> DataFrame:
    """Profile of all parts together: a row for every column of the table with ``schema``.

    Columns: column, type, count, nulls, min and max as text, avg (numbers only) and ndv (estimated).
    """
    aggs, rows, none = [], [], F.lit(None)
    for i, f in enumerate(schema.fields):
        aggs += [F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"z{i}").alias(f"z{i}")]
        if _plain(f):
            aggs += [F.min(f"lo{i}").cast("string").alias(f"lo{i}"), F.max(f"hi{i}").cast("string").alias(f"hi{i}"),
                     F.sum(f"su{i}").alias(f"su{i}"), F.hll_sketch_estimate(F.hll_union_agg(f"sk{i}")).alias(f"nd{i}")]
        number = _plain(f) and isinstance(f.dataType, T.NumericType)
        rows.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            F.coalesce(f"n{i}", F.lit(0)).alias("count"), F.coalesce(f"z{i}", F.lit(0)).alias("nulls"),
            (F.col(f"lo{i}") if _plain(f) else none.cast("string")).alias("min"),
            (F.col(f"hi{i}") if _plain(f) else none.cast("string")).alias("max"),
            (F.try_divide(F.col(f"su{i}"), F.col(f"n{i}")) if number else none.cast("double")).alias("avg"),
            (F.col(f"nd{i}") if _plain(f) else none.cast("bigint")).alias("ndv")))
    return parts.agg(*aggs).select(F.inline(F.array(*rows)))


def exact_ndv(df: DataFrame) -> DataFrame:
    """Exact number of values of every column that is not nested: (column, ndv).

    The table is turned into rows (column, value) once, and equal ones combine before the shuffle; NULL is no value.
    """
    pairs = [F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value"))
             for f in df.schema.fields if _plain(f)]
    values = df.select(F.inline(F.array(*pairs))).distinct()
    return values.groupBy("column").agg(F.count("value").alias("ndv"))
