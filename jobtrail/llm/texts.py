"""Small helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java pattern of the white space between words.
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, evaluated once although ``body`` mentions it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named input columns under internal names; all others cannot clash."""
    return df.select(*[df[source].alias(name) for name, source in wanted.items()])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of equally long columns."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in (out[n] for n in names)],
                names=names)

    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts hold about ``limit`` bytes, so memory does not follow the
    length of the texts in a batch; a single longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for at, length in enumerate(lengths):
            if size and size + length > limit:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += length
        if batch.num_rows > start:
            yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()
