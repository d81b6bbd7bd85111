"""Benchmark decontamination with an Aho-Corasick automaton over benchmark windows.

Texts are normalised to words joined by single spaces, so that one scan finds every occurrence of
every window at word boundaries; word positions lead back to code points of the original text. A
window is ``WINDOW`` consecutive words of an item, or the whole item if it has fewer words.

The windows are cut into blocks of at most ``BLOCK_BYTES``, measured before anything is broadcast.
Each block is one automaton and one pass over the documents; the hits of a pass travel with the
rows to the next one, so no pass joins or shuffles texts.

Defined cases: NULL or wordless texts and items have no words and no windows; a NULL ``item_id``
still marks words but is not listed; repeated items count once, repeated documents are judged
each; an empty benchmark marks nothing. Further columns are not touched and may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.texts import columns, map_arrow, pieces, raw
from jobtrail.session import stage

WINDOW = 10
BLOCK_BYTES = 4 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(128)).lower()
_NORMAL = bytes(c if chr(c).isalnum() else 32 for c in _LOWER) + bytes(range(128, 256))
#: The automaton of the block a Python worker scanned last.
_built: dict[int, ahocorasick.Automaton] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def _padded(words: list[bytes]) -> str:
    # One character for each byte: offsets of the scan are byte offsets.
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item) rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            found = {"pattern": [], "item": [], "words": []}
            for item, body in zip(batch.column("item").to_pylist(), raw(batch.column("text"))):
                words = words_of(body)
                if not words:
                    continue
                for at in range(max(1, len(words) - window + 1)):
                    part = words[at:at + window]
                    found["pattern"].append(_padded(part).encode("latin-1"))
                    found["item"].append(item)
                    found["words"].append(len(part))
            yield found

    rows = columns(benchmark, item=item_id, text=text).select(F.col("item").cast("string"), "text")
    return map_arrow(rows, lambda b: (_typed(x) for x in cut(b)), "pattern binary, item string, words int").distinct()


def _typed(found: dict) -> dict:
    kinds = {"pattern": pa.binary(), "item": pa.string(), "words": pa.int32()}
    return {k: pa.array(found[k], kind) for k, kind in kinds.items()}


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
           block_bytes: int = BLOCK_BYTES):
    """Broadcasts of [(pattern, words, items)], each of bounded size."""
    spark = benchmark.sparkSession
    rows = stage(windows(benchmark, item_id, text, window), "windows")
    size = rows.agg(F.sum(F.length("pattern") + F.coalesce(F.length("item"), F.lit(0)) + 16)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for block in range(count):
        part = rows.filter(F.pmod(F.xxhash64("pattern", "item"), F.lit(count)) == block)
        patterns: dict[bytes, tuple[int, list[str | None]]] = {}
        for row in part.collect():  # at most about block_bytes
            patterns.setdefault(bytes(row["pattern"]), (row["words"], []))[1].append(row["item"])
        yield spark.sparkContext.broadcast([(p, n, items) for p, (n, items) in patterns.items()])


def _automaton(block) -> ahocorasick.Automaton | None:
    key = zlib.crc32(repr(block.value).encode()) if block.value else 0
    if key not in _built:
        _built.clear()
        machine = ahocorasick.Automaton()
        for pattern, count, items in block.value:
            machine.add_word(pattern.decode("latin-1"), (count, tuple(items)))
        machine.make_automaton()
        _built[key] = machine if block.value else None
    return _built[key]


def find_words(machine: ahocorasick.Automaton | None, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged [first, last) word ranges inside occurrences, and the items that occur."""
    if machine is None or not words:
        return [], set()
    ranges, items, starts = [], set(), None
    for end, (count, owners) in machine.iter(_padded(words)):
        if starts is None:
            starts = np.cumsum([1] + [len(w) + 1 for w in words]).tolist()
        last = bisect_right(starts, end)  # the words that begin before the closing space
        ranges.append((last - count, last))
        items.update(owners)
    return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [start, end) code points of the text that was normalised."""
    if not ranges:
        return []
    found = [m.span() for m in _WORD.finditer(text.translate(_ASCII_LOWER))]
    return [(found[first][0], found[last - 1][1]) for first, last in ranges]


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, hit words, items found, their digest, hit spans, verdict."""
    rows = columns(docs, id=doc_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    carried = rows.withColumn("hits", F.array().cast("array<int>")).withColumn("items", F.array().cast("array<string>"))
    for number, block in enumerate(blocks(benchmark, item_id, item_text, window, block_bytes)):
        if number:
            carried = stage(carried, "hits")

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[dict]:
            machine = _automaton(block)
            for batch in pieces(batches, "text"):
                hits, items = [], []
                old = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist())
                for body, (before, known) in zip(raw(batch.column("text")), old):
                    ranges, found = find_words(machine, words_of(body))
                    ranges = merged(ranges + list(zip(before[::2], before[1::2])))
                    hits.append([x for r in ranges for x in r])
                    items.append(sorted({*known, *(x for x in found if x is not None)}))
                yield {"id": batch.column("id"), "text": batch.column("text"),
                       "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}

        carried = map_arrow(carried, run, f"id {kind}, text string, hits array<int>, items array<string>")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            out: dict = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
            rest = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist())
            for body, (hits, items) in zip(raw(batch.column("text")), rest):
                ranges = list(zip(hits[::2], hits[1::2]))
                out["n_words"].append(len(words_of(body)))
                out["n_hit"].append(sum(b - a for a, b in ranges))
                out["n_items"].append(len(items))
                out["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                out["contaminated"].append(bool(ranges))
                spans = original_spans(body.decode(), ranges) if ranges else []
                out["spans"].append(",".join(f"{a}:{b}" for a, b in spans))
            yield {doc_id: batch.column("id"), **{
                k: pa.array(v, _KINDS.get(k, pa.int64())) for k, v in out.items()}}

    return map_arrow(
        carried, finish,
        f"{doc_id} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")


_KINDS = {"items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": pa.string()}


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, in their columns; nothing is shuffled."""
    at = docs.columns.index(text)
    for number, block in enumerate(blocks(benchmark, item_id, item_text, window, block_bytes)):
        if number:  # one automaton at a time in a task
            docs = stage(docs, "clean")

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            machine = _automaton(block)
            for batch in batches:
                keep = [not find_words(machine, words_of(body))[0] for body in raw(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
