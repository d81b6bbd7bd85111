"""What each of five filters removes in every order they can be applied in, per part of the corpus.

Method: wide packed counters. A document fails a set of filters, its mask. Every mask (with the
document's labels) maps to one big integer of fixed fields: for each of the 120 orders and five
steps, one field for each count, holding 0 or 1. The integers of all documents of a part are added
as they are, so a single addition moves all counters; fields are 64 bits wide and no part has 2^64
documents, so no field runs over into the next and unpacking is a plain read of 64-bit words.

Filters (the condition says when a document fails; words are runs without ASCII white space)::

    A  fewer than 200 words                       D  holds one of # $ % & * |
    B  fewer than 50 percent distinct words       E  same text as a document with a smaller id
    C  more than 2 percent capital letters A-Z

Texts are read once, in Arrow batches, and leave one narrow row a document: id, part, four bits and
a 128-bit digest of the text. Whether a text has a smaller id elsewhere is a matter of counts, so
copies are counted by (digest, part, labels) with map-side combine and no row is joined with the
rest of its group: of a text held by a third of all rows, a few rows for each part reach the group.
The packed sums of each task are then added in two rounds, first over 64 slices of every part.

Defined cases: a NULL text is the empty text and equals it; a NULL source is the part ``''``; a
NULL id is neither smaller than another nor has a smaller one, and has no labels; repeated rows
count as often as they occur, and rows of equal id are no copies of each other; labels that repeat
count when any of them says 1; an empty table has no part and no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtrail.llm.texts import map_arrow, pieces, raw

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Counts of one step, in the order of their fields.
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bytes of a field: as many as a long has, so the sum of a part fits.
WIDTH = 8
#: Slices of a part in the first round of adding up.
SLICES = 64
#: Packed sums that one task holds at a time (29 KB each).
HELD = 512
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"


def features(documents: DataFrame) -> DataFrame:
    """One narrow row a document: id, part, the bits of A to D, and the digest of its text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "_text"):
            points = pc.fill_null(pc.utf8_length(batch.column("_text")), 0).to_pylist()
            bits, digests = [], []
            for text, n in zip(raw(batch.column("_text")), points, strict=True):
                text = text or b""
                words = text.split()  # of bytes: exactly the ASCII white space
                bits.append(
                    (len(words) < 200)
                    | (100 * len(set(words)) < 50 * len(words)) << 1
                    | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > 2 * n) << 2
                    | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3)
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield {"_id": batch.column("_id"), "_part": batch.column("_part"),
                   "_bits": pa.array(bits, pa.int32()), "_digest": pa.array(digests, pa.binary())}

    narrow = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"),
                              F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_part"))
    return map_arrow(narrow, read, "_id long, _part string, _bits int, _digest binary")


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents of a part have which mask and labels: (part, mask, good, toxic, n).

    A part and mask may come in several rows; their counts add up.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"))
    group = ["_digest", "_part", "_bits", "_good", "_toxic"]
    rows = features(documents).join(known, "_id", "left").withColumns({
        "_good": F.coalesce("_good", F.lit(False)), "_toxic": F.coalesce("_toxic", F.lit(False))})
    # Rows of one id stay together first, so that the smallest id knows how often it occurs.
    ids = rows.groupBy(*group, "_id").agg(F.count("*").alias("_n"))
    held = ids.groupBy(*group).agg(
        F.sum("_n").alias("_n"), F.min("_id").alias("_first"), F.coalesce(F.min_by("_n", "_id"), F.lit(0)).alias("_n_first"),
        F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_n_null"))
    # At most one row for each part, mask and label of a text is left.
    first = F.min("_first").over(W.partitionBy("_digest"))
    passing = F.col("_n_null") + F.when(F.col("_first") == first, F.col("_n_first")).otherwise(0)
    both = F.array(F.struct(F.lit(0).alias("e"), F.col("_passing").alias("n")),
                   F.struct(F.lit(16).alias("e"), (F.col("_n") - F.col("_passing")).alias("n")))
    return held.withColumn("_passing", passing).select(
        "_part", "_bits", "_good", "_toxic", F.explode(both).alias("x")).filter("x.n > 0").select(
        F.col("_part").alias("part"), (F.col("_bits") + F.col("x.e")).alias("mask"), F.col("_good").alias("good"),
        F.col("_toxic").alias("toxic"), F.col("x.n").alias("n"))


def outcome(mask: int, good: bool, toxic: bool) -> int:
    """The big integer of one document: every field of all 600 steps, 0 or 1."""
    fields = bytearray(len(ORDERS) * len(FILTERS) * len(FIELDS) * WIDTH)
    at = 0
    for order in ORDERS:
        gone = False
        for name in order:
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            removed = fails and not gone
            redundant = fails and gone
            gone = gone or fails
            for value in (not gone, removed, redundant, mask == bit, removed and good, removed and toxic):
                fields[at] = value
                at += WIDTH
    return int.from_bytes(fields, "little")


def unpack(total: int) -> np.ndarray:
    """Fields of a sum, as an array of orders, steps and FIELDS."""
    words = total.to_bytes(len(ORDERS) * len(FILTERS) * len(FIELDS) * WIDTH, "little")
    return np.frombuffer(words, "<i8").reshape(len(ORDERS), len(FILTERS), len(FIELDS))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step with all counts, zeros included."""
    slices = F.pmod(F.spark_partition_id(), F.lit(SLICES))
    packed = map_arrow(masks(documents, labels), _pack, "part string, packed binary").withColumn("slice", slices)
    some = map_arrow(packed.repartition("part", "slice").select("part", "packed"), _add, "part string, packed binary")
    whole = map_arrow(some.repartition("part").sortWithinPartitions("part"), _add_sorted, "part string, packed binary")
    counts = ", ".join(f"{name} long" for name in (*FIELDS, "shapley"))
    return map_arrow(whole, _report, f"part string, filter_order string, step int, {counts}")


def _sums(rows: Iterator[tuple[str, int]]) -> Iterator[dict]:
    """Sums by part; a task that meets many parts gives them out in between."""
    held: dict[str, int] = {}
    for part, value in rows:
        held[part] = held.get(part, 0) + value
        if len(held) >= HELD:
            yield _rows(held)
            held = {}
    if held:
        yield _rows(held)


def _rows(held: dict[str, int]) -> dict:
    size = len(ORDERS) * len(FILTERS) * len(FIELDS) * WIDTH
    return {"part": pa.array(held, pa.string()), "packed": pa.array([v.to_bytes(size, "little") for v in held.values()], pa.binary())}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    known: dict[tuple, int] = {}

    def rows() -> Iterator[tuple[str, int]]:
        for batch in batches:
            for part, n, *key in zip(*[batch.column(c).to_pylist() for c in ("part", "n", "mask", "good", "toxic")], strict=True):
                if (value := known.get(tuple(key))) is None:
                    value = known[tuple(key)] = outcome(*key)
                yield part, n * value

    return _sums(rows())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    for batch in batches:
        for part, value in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            yield part, int.from_bytes(value, "little")


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return _sums(_packed(batches))


def _add_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Sums of rows that are sorted by part: exactly one row a part."""
    last, total = None, 0
    for part, value in _packed(batches):
        if last is not None and part != last:
            yield _rows({last: total})
            total = 0
        last, total = part, total + value
    if last is not None:
        yield _rows({last: total})


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    letters = [FILTERS.index(name) for order in ORDERS for name in order]
    for part, value in _packed(batches):
        fields = unpack(value).reshape(-1, len(FIELDS))
        shapley = np.zeros(len(FILTERS), np.int64)
        np.add.at(shapley, letters, fields[:, FIELDS.index("removed")])
        yield {
            "part": pa.array([part] * len(letters), pa.string()),
            "filter_order": pa.array([order for order in ORDERS for _ in FILTERS]),
            "step": pa.array([k + 1 for _ in ORDERS for k in range(len(FILTERS))], pa.int32()),
            **{name: pa.array(fields[:, k].copy()) for k, name in enumerate(FIELDS)}, "shapley": pa.array(shapley[letters])}
