"""Small function-surface gaps as expressions over built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(value: Column, *choices) -> Column:
    """1-based place of ``value`` among the choices, 0 when absent or NULL."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in choices]), value), F.lit(0)).cast("int")


def index(container: Column, at) -> Column:
    """Element of an array (0-based, NULL out of range)."""
    return F.get(container, F.lit(at) if isinstance(at, int) else at)


def index_map(container: Column, key) -> Column:
    """Value of a map key, NULL when absent."""
    return F.try_element_at(container, F.lit(key))


def parse_url_tuple(url: Column, parts: Sequence[str]) -> list[Column]:
    """One column per requested URL part; ``QUERY:name`` picks one parameter. Bad URLs give NULL."""
    out = []
    for part in parts:
        name, _, key = part.partition(":")
        args = [F.lit(name)] + ([F.lit(key)] if key else [])
        out.append(F.try_parse_url(url, *args).alias(part.lower().replace(":", "_")))
    return out


def xpath_texts(doc: Column, *paths: str) -> Column:
    """Values of XPath expressions as an array of texts; NULL for a NULL document.

    Each ``xpath`` function of Spark parses its document anew, and that is nearly all of its time, so the
    expressions are joined to one. U+0001 parts them, which no XML 1.0 document may hold. A number that
    cannot be told is ``NaN``, a path without node is empty, a path with several gives its first node.
    """
    texts = "".join(f"string({p}), '\x01', " for p in paths)
    return F.slice(F.split(F.xpath_string(doc, F.lit(f"concat({texts}'')")), "\x01", -1), 1, len(paths))


def in_file(df: DataFrame, col: str, path: str, out: str = "in_file") -> DataFrame:
    """Flag rows whose value is a line of the file; the file is read as a table and joined."""
    words = df.sparkSession.read.text(path).select(F.col("value").alias("_word")).distinct()
    hits = words.withColumn("_hit", F.lit(True))
    joined = df.join(hits, F.col(col).cast("string") == F.col("_word"), "left")
    return joined.withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_word", "_hit")
