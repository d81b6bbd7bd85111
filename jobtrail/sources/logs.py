"""Log files as tables of lines with a total order inside each file.

The text source splits large files, so a line number is not available from the reader. The
offset of the split and the position inside it are: ordering by (file, block, row) restores the
file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.sources.containers import read_container_logs  # noqa: F401


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines under ``path`` as (file, block, row, line)."""
    reader = spark.read.options(recursiveFileLookup="true", **options)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def task_lines(lines: DataFrame) -> DataFrame:
    """Add stream, operator, date and task id to (file, ..) lines, all taken from the file name.

    Files are laid out as ``<stream>/<date>/<opid>_<time>.<ext>``, or in the partitioned form
    of the same layout, ``stream=../log_date=../task=<opid>_<time>/..``. The task id is operator,
    date and time joined.
    """
    layout = (r"/(?:stream=)?(stdout|stderr)/(?:log_date=)?([0-9-]{10})/(?:task=)?"
              r"([^/]+)_([0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{3})(?:\.[a-z]+|/[^/]+)$")
    # The reader reports an encoded path; a plus sign in it is literal.
    decoded = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))

    def part(i: int) -> Column:
        return F.regexp_extract("file", layout, i)

    return lines.withColumn("file", decoded).filter(F.col("file").rlike(layout)).select(
        F.concat(part(3), part(2), F.lit("_"), part(4)).alias("otid"),
        part(3).alias("opid"), part(1).alias("stream"), part(2).alias("log_date"), *lines.columns,
    )


def read_task_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all task logs under ``path``, see :func:`task_lines`."""
    return task_lines(read_lines(spark, path))


def application_of_container(container: Column) -> Column:
    """Application id of a container id (``container_[e<epoch>_]<stamp>_<number>_<attempt>_<no>``)."""
    pattern = r"^container_(?:e[0-9]+_)?([0-9]{13}_[0-9]+)_[0-9]+_[0-9]+$"
    found = F.nullif(F.regexp_extract(container, pattern, 1), F.lit(""))
    return F.concat(F.lit("application_"), found)
