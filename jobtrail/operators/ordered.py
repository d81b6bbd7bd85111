"""Numbering and neighbours inside ordered groups, safe for groups of any size.

A window over a key sorts the whole key in one task. That is the cheapest plan while every key
fits one task, so :func:`sequence_rows` first measures the largest key (a count with map-side
combine that returns one number). Keys above ``group_limit`` rows leave the window path: their
rows are range-partitioned on key *and* order, which spreads one key over many tasks, and get
their number from the position inside the partition plus the rows of the key in the
partitions before it. Both paths return the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtrail.session import stage

#: Rows of one key that one task may sort.
GROUP_LIMIT = 5_000_000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match each other; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_k_{k}" for k in keys])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def group_bound(keys: Sequence[str], parts: int = 4096) -> Column:
    """What to count rows by for an upper bound of the largest key: one of ``parts`` shares of all keys.

    Such counts shuffle ``parts`` rows a task, however many keys there are.
    """
    return F.pmod(F.xxhash64(*keys), F.lit(parts))


def sequence_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    number: str = "sequence",
    following: dict[str, str | tuple[str, int]] | None = None,
    group_limit: int = GROUP_LIMIT,
    largest: int | None = None,
    number_type: str = "int",
    once: bool = False,
) -> DataFrame:
    """Number the rows of each key from 1 in ``order`` (which must be unique per key).

    With ``once`` it need not be: of rows alike in key and order one stays, the others get no number and go.

    ``following`` maps new columns to existing ones and fills them from the next row of the key,
    or from ``k`` rows ahead when given as (column, k). ``largest`` is an upper bound of the
    largest key where the caller already knows one; otherwise it is measured, so pass a table
    or a staged result. Keys beyond two billion rows need ``number_type="bigint"``.
    """
    keys, order = list(keys), list(order)
    following = {out: (s, 1) if isinstance(s, str) else s for out, s in (following or {}).items()}
    if (largest_group(df, keys) if largest is None else largest) <= group_limit:
        return _by_window(df, keys, order, number, following, number_type, once)

    counts = df.groupBy(*keys).count().filter(F.col("count") > group_limit)
    hot = stage(counts, "hot-keys")
    hot_rows = hot.agg(F.sum("count")).first()[0]
    if hot_rows is None:
        return _by_window(df, keys, order, number, following, number_type, once)
    keys_only = hot.drop("count")
    cold = join_keys(df, keys_only, keys, "left_anti")
    warm = join_keys(df, keys_only, keys, "left_semi")
    pieces = max(2, -(-2 * hot_rows // group_limit))
    if once:
        warm = warm.dropDuplicates([*keys, *order])  # dealt by key and order, so a huge key spreads here too
    return _by_window(cold, keys, order, number, following, number_type, once).unionByName(
        _by_range(warm, keys, order, number, following, number_type, pieces)
    )


def _by_window(df, keys, order, number, following, number_type, once=False) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    columns = {number: F.row_number().over(w).cast(number_type)}
    if once:
        # Rows that come again share their rank; all three numbers come from one sort.
        numbers = {number: F.dense_rank().over(w).cast(number_type), "_first": F.row_number().over(w) == F.rank().over(w)}
        df, columns = df.withColumns(numbers).filter("_first").drop("_first"), {}
    columns.update({out: F.lead(source, k).over(w) for out, (source, k) in following.items()})
    return df.withColumns(columns) if columns else df


def _by_range(df, keys, order, number, following, number_type, pieces) -> DataFrame:
    ranged = (
        df.repartitionByRange(pieces, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # The positions are written with the rows: range bounds are sampled, so the same exchange
    # planned twice could cut elsewhere.
    ranged = stage(ranged, "ranged").withColumn("_piece", F.shiftright("_at", 33))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    # One row per (key, partition): at most hot keys + partitions, whatever the data size.
    starts = (
        ranged.groupBy(*keys, "_piece")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    numbered = join_keys(ranged, starts, [*keys, "_piece"]).select(
        *df.columns, position.cast(number_type).alias(number)
    )
    # The row k places ahead is the row whose number is k higher: an equi-join on
    # (key, number), so even a single huge key spreads evenly.
    rows = numbered
    for k in sorted({k for _, k in following.values()}):
        ahead = rows.select(
            *keys, (F.col(number) - F.lit(k)).cast(number_type).alias(number),
            *[F.col(source).alias(out) for out, (source, step) in following.items() if step == k],
        )
        numbered = join_keys(numbered, ahead, [*keys, number], "left")
    return numbered


def first_by_position(df: DataFrame, keys: Sequence[str], value: str, position: str,
                      matches: Column, out: str = "first_value") -> DataFrame:
    """Value of the first matching row of each key; the aggregate combines map-side."""
    return df.filter(matches).groupBy(*keys).agg(F.min_by(value, position).alias(out))


def last_by_position(df: DataFrame, keys: Sequence[str], value: str, position: str | Column,
                     matches: Column | None = None, out: str = "last_value") -> DataFrame:
    """Value of the last matching row of each key."""
    rows = df if matches is None else df.filter(matches)
    return rows.groupBy(*keys).agg(F.max_by(value, position).alias(out))
