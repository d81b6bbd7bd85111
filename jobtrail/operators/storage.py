"""Storage use against quota, and selection of expired files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C


def with_group(files: DataFrame, root: str) -> DataFrame:
    """Add the group a file belongs to: the first directory below ``root``, which the path must begin
    with (after scheme and host). Files elsewhere, and files right in ``root``, drop out."""
    pattern = "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*)?" + re.escape(root) + "([^/]+)/"
    return files.filter(F.col("path").rlike(pattern)).withColumn("group_name", F.regexp_extract("path", pattern, 1))


def storage_usage(files: DataFrame, quotas: DataFrame) -> DataFrame:
    """Bytes and files of each group against its quota; sizes add up before the join.

    Groups that have a quota and no file are reported with 0 bytes, groups without quota with NULL.
    """
    used = files.groupBy("group_name").agg(F.sum("size_bytes").alias("used_bytes"), F.count("*").alias("n_files"))
    return used.join(quotas.select("group_name", "quota_bytes"), "group_name", "full").withColumns({
        "used_bytes": F.coalesce("used_bytes", F.lit(0)), "n_files": F.coalesce("n_files", F.lit(0)),
    }).withColumn("over_quota", F.coalesce(F.col("used_bytes") > F.col("quota_bytes"), F.lit(False)))


def is_expired(mtime: Column, as_of: str, days: int = C.RETENTION_DAYS) -> Column:
    """Strictly older than ``days`` before ``as_of``; a constant bound, so it prunes partitions."""
    return mtime < F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))


def split_expired(files: DataFrame, as_of: str, days: int = C.RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """Expired and kept files. Deleting is the caller's business."""
    old = is_expired(F.col("mtime"), as_of, days)
    # Plain comparisons, so that both filters reach the scan; a file without a time is kept.
    return files.filter(old), files.filter(~old | F.col("mtime").isNull())
