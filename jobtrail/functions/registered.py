"""Applying functions known by their registered name."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def register_vectorized(spark: SparkSession, name: str, fn, return_type: str | DataType) -> None:
    """Register a function over pandas Series; rows travel in Arrow batches."""
    spark.udf.register(name, F.pandas_udf(fn, return_type))


def register_jvm(spark: SparkSession, name: str, class_name: str, jar: str | None = None) -> None:
    """Register a JVM class under ``name``; executors fetch the jar from its shared location."""
    using = f" USING JAR '{jar}'" if jar else ""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} AS '{class_name}'{using}")


def register_table_function(spark: SparkSession, name: str, handler, return_type: str) -> None:
    """Register a class with ``eval`` as a table function for LATERAL use."""
    spark.udtf.register(name, F.udtf(handler, returnType=return_type))


def apply_function(df: DataFrame, name: str, cols: Sequence[str], out: str) -> DataFrame:
    """Add the result of a registered or built-in function."""
    return df.withColumn(out, F.call_function(name, *[F.col(c) for c in cols]))


def apply_aggregate(df: DataFrame, keys: Sequence[str], partial, merge, finish, cols: Sequence[str],
                    state: str, out: str, return_type: str) -> DataFrame:
    """Aggregate with a user function in mergeable steps.

    ``partial(pdf) -> dict`` folds a batch of rows of one key into a state, and the states of a
    key are merged with ``merge`` (built-in aggregates per state column), so a key never has to
    fit in one task. ``finish`` turns the merged state columns into the result.
    """
    keys = list(keys)
    fields = [part.split() for part in state.split(",")]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [" ".join(f) for f in fields])

    def fold(batches):
        for pdf in batches:
            rows = [
                {**{k: None if pd.isna(v) else v for k, v in zip(keys, key)}, **partial(group)}
                for key, group in pdf.groupby(keys, dropna=False, sort=False)
            ]
            yield pd.DataFrame(rows, columns=[*keys, *[f[0] for f in fields]])

    states = df.select(*keys, *[c for c in cols if c not in keys]).mapInPandas(fold, schema)
    merged = states.groupBy(*keys).agg(*[merge[name](name).alias(name) for name, _ in fields])
    return merged.select(*keys, finish.cast(return_type).alias(out))
