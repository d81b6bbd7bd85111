"""Directory listings as tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.session import stage


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, mtime) of every file below ``path`` that has content.

    The content column is never selected, so the reader opens no file. Spark's file index skips
    empty files; they hold no bytes and do not appear here. :func:`walk_files` lists them too.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", F.col("length").alias("size_bytes"),
                        F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))


LISTED = "path string, name string, is_dir boolean, size_bytes bigint, mtime timestamp"


def walk_files(spark: SparkSession, path: str, tasks: int = 64) -> DataFrame:
    """Every file and directory below ``path``, empty ones included, as (path, is_dir, size_bytes, mtime).

    The walk goes level by level: the directories of a level are dealt to tasks, each lists its share, and the
    directories they find are the next level. The driver knows the number of a level's directories
    only. ``path`` is relative to the root. A directory that vanishes during the walk counts as empty; a
    missing root gives no row. Names that begin with ``_`` or ``.`` are listed like all others.
    """
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                selector = fs.FileSelector(f"{root}/{folder}" if folder else root, allow_not_found=True)
                for entries in _slices(system.get_file_info(selector)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{folder}/{e.base_name}" if folder else e.base_name for e in entries], pa.string()),
                        pa.array([e.base_name for e in entries], pa.string()),
                        pa.array([e.type == fs.FileType.Directory for e in entries], pa.bool_()),
                        pa.array([e.size or 0 for e in entries], pa.int64()),
                        pa.array([e.mtime_ns // 1000 if e.mtime_ns else None for e in entries], pa.timestamp("us", "UTC")),
                    ], names=["path", "name", "is_dir", "size_bytes", "mtime"])

    level = spark.createDataFrame([("",)], "path string")
    levels: list[DataFrame] = []
    while not levels or not level.isEmpty():
        found = stage(level.repartition(tasks, "path").mapInArrow(enter, LISTED), "listing")
        levels.append(found)
        level = found.filter("is_dir").select("path")
    every = reduce(DataFrame.unionAll, levels)
    return every.select("path", "is_dir", "size_bytes", F.col("mtime").cast("timestamp_ntz").alias("mtime"))


def _slices(entries: list, size: int = 10_000) -> Iterator[list]:
    return (entries[k:k + size] for k in range(0, len(entries), size))
