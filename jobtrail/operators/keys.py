"""Lookups, existence tests, updates and deletes for whole batches of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C


def fetch(table: DataFrame, keys: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``table`` whose key is requested, reduced to ``cols``."""
    found = table.join(keys.select(key), key, "left_semi")
    return found.select(*cols) if cols else found


def task_status(optask: DataFrame, ids: DataFrame) -> DataFrame:
    """Status and submit time of each requested task; unknown ids come back as NOT_EXIST."""
    known = optask.select("otid", "status", "submit_ts", F.lit(True).alias("_known"))
    return ids.select("otid").join(known, "otid", "left").select(
        "otid",
        F.when(F.col("_known"), F.col("status")).otherwise(C.NOT_EXIST).alias("status"),
        "submit_ts",
    )


def task_by_instance(optask: DataFrame, keys: DataFrame) -> DataFrame:
    """Task of each (jobinstanceid, opid); the latest submission wins."""
    on = ["jobinstanceid", "opid"]
    wanted = keys.select(*on).distinct()
    last = (
        optask.join(wanted, on, "left_semi")
        .groupBy(*on)
        .agg(F.max_by("otid", F.struct("submit_ts", "otid")).alias("otid"))
    )
    return wanted.join(last, on, "left").withColumn("otid", F.coalesce("otid", F.lit(C.NOT_EXIST)))


def apps_of_task(apptask: DataFrame, ids: DataFrame) -> DataFrame:
    """All applications of the requested tasks, one row each, ordered by ``sequence``.

    Rows rather than one array per task: a task may own any number of applications.
    """
    return apptask.join(ids.select("otid"), "otid", "left_semi").select("otid", "sequence", "appid")


def is_unfinished(status: Column, strict: bool = False) -> Column:
    """Neither SUCCEEDED nor FAILED; a missing status counts as unfinished.

    ``strict`` also treats KILLED as finished.
    """
    done = [C.SUCCEEDED, C.FAILED] + ([C.KILLED] if strict else [])
    return ~F.coalesce(status, F.lit("")).isin(*done)


def unfinished_apps(apptask: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    live = apptask.filter(is_unfinished(F.col("status"), strict))
    return live.join(ids.select("otid"), "otid", "left_semi")


def mark_existing(batch: DataFrame, registry: DataFrame, key: str, out: str = "exists") -> DataFrame:
    """Add a flag telling whether the key is registered; keeps every batch row once."""
    known = registry.select(key).distinct().withColumn(out, F.lit(True))
    return batch.join(known, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def split_existing(batch: DataFrame, registry: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Batch rows whose key is registered, and those whose key is not."""
    known = registry.select(key)
    return batch.join(known, key, "left_semi"), batch.join(known, key, "left_anti")


def apply_updates(table: DataFrame, updates: DataFrame, key: str, cols: Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """Set ``cols`` from the latest update of each key; other rows and columns stay.

    Updates collapse to one row per key before the join, so a key with very many updates
    costs one row.
    """
    latest = updates.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_new"), F.lit(True).alias("_hit")
    )
    joined = table.join(latest, key, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in table.columns
    ])


def apply_deletes(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")
