"""Repeated passages: every byte covered by a 100-byte string that starts earlier as well is removed.

Method: suffix arrays of shards by external induced sorting (:mod:`jobtrail.llm.induced_sort`). Suffixes
whose common-prefix length is 100 or more are occurrences of one string; all but the earliest (smaller
document, then earlier place) are covered.

Shards are cut by content, so that equal strings meet and no string of the corpus has to. A string of 100
bytes belongs to the place of the smallest hash among the 32-byte grams inside it (the leftmost of
equal ones); neighbouring strings mostly belong to the same place, and a *unit* is such a row of strings,
100 to 168 bytes. Equal strings lie at the same distance from equal grams, so the hash of the
gram is the shard key. The steps:

1. Texts become units in Arrow batches. Units repeated within a batch are decided there, so of
   a text that fills a third of the corpus each batch sends one row a unit.
2. One exchange by gram brings equal units together, sorted; a stream over the sorted rows decides exact
   copies of a unit, and keeps those units whose gram also occurs in other surroundings.
3. Only the bytes of the latter are fetched and suffix-sorted, sorted by gram and cut into shards of about
   ``SHARD`` bytes between two grams, one shard after the other in a task.
4. The covered ranges of each text are united and cut out.

A short line that very many documents share would bring all their surroundings into one shard.
Therefore grams that are frequent in a bounded sample of documents (``SAMPLE``, at most ``FREQUENT``
grams) get the largest hashes: a string with any other gram in it belongs to that. This choice moves work
only; any set of grams gives the same result.

Units are compared by a 64-bit gram hash and 64 bits of BLAKE2b over all their bytes; shards compare bytes.
Spill files of the sorter are local to one task, as Spark's own spills are, and no other task reads them.
Texts are shuffled compressed.

Defined cases: a NULL text has no bytes; strings never cross documents; texts below 100 bytes stay
whole; a NULL id counts as the largest; rows with the same id and text are one document and get
the same result; rows with the same id and different texts are ordered by a hash of the text; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.induced_sort import Spool, room, sorted_suffixes
from jobtrail.llm.texts import map_arrow, pieces, raw
from jobtrail.session import stage

#: Bytes of a string that counts as repeated, and of a gram.
WIDTH = 100
GRAM = 32
#: Bytes of text in one array, and of units in one shard.
BATCH = 4 << 20
SHARD = 2 << 20
#: Documents looked at for frequent grams, how often a gram must occur in them, and how many are kept.
SAMPLE = 20_000
OFTEN = 100
FREQUENT = 4096
#: Queue entries a sorter keeps in memory, and the longest string it sorts by doubling.
LIMIT = 4 << 20
_MASK = np.uint64((1 << 23) - 1)
_TOP = np.uint64(1 << 63)
_NO_ID = 2**63 - 1
#: A span is a place, shifted, and a number of strings; what is decided is the span's complement.
_SHIFT = 24
_COUNT = (1 << _SHIFT) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h, k = _mixed(data.astype(np.uint64) + np.uint64(1)), 1
    while k < GRAM:
        h = _mixed(h[:-k] * np.uint64(3) + h[k:] * np.uint64(7) + np.uint64(k))
        k *= 2
    return h


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[:len(values) - (width - k)], values[width - k:]) if k < width else values


class Chunks:
    """Pieces of texts of at most BATCH bytes in one array; every string of WIDTH bytes lies in one piece."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.texts: list[int] = []
        self.starts: list[int] = []
        self.size = 0

    @staticmethod
    def of(texts: list[bytes]) -> Iterator[Chunks]:
        held = Chunks()
        for k, text in enumerate(texts):
            for at in range(0, max(len(text) - WIDTH + 1, 0), BATCH):
                part = text[at:at + BATCH + WIDTH - 1]
                if held.size and held.size + len(part) > BATCH:
                    yield held
                    held = Chunks()
                held.parts.append(part)
                held.texts.append(k)
                held.starts.append(at)
                held.size += len(part)
        if held.size:
            yield held

    def units(self, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text number, place in the text, number of strings, gram and digest of every unit, in order."""
        data = b"".join(self.parts)
        lengths = np.array([len(p) for p in self.parts])
        grams = _gram_hashes(np.frombuffer(data, np.uint8))
        rank = grams >> np.uint64(1)
        if len(frequent):
            sieve = np.zeros(1 << 20, bool)
            sieve[(frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            hits = np.flatnonzero(sieve[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
            rank[hits[np.isin(grams[hits], frequent)]] |= _TOP
        # Place in the low bits: of equal hashes the leftmost wins.
        owner = _smallest(rank & ~_MASK | np.arange(len(rank), dtype=np.uint64), WIDTH - GRAM + 1)
        owner = (owner & _MASK).astype(np.int64)
        piece = np.repeat(np.arange(len(lengths)), lengths)[:len(owner)]
        whole = np.arange(len(owner)) + WIDTH <= np.cumsum(lengths)[piece]
        opens = np.ones(len(owner), bool)
        opens[1:] = (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1])
        start = np.flatnonzero(opens)
        count = np.diff(np.append(start, len(owner)))
        start, count = start[whole[start]], count[whole[start]]
        digests = np.frombuffer(b"".join([
            hashlib.blake2b(data[a:b], digest_size=8).digest()
            for a, b in zip(start.tolist(), (start + count + WIDTH - 1).tolist(), strict=True)]), np.int64)
        piece = piece[start]
        first = np.cumsum(lengths) - lengths
        return (np.array(self.texts)[piece], start - first[piece] + np.array(self.starts)[piece], count,
                grams[owner[start]].view(np.int64), digests)


def _documents(documents: DataFrame) -> DataFrame:
    """(id, key, text): ``id`` gives the order of documents, ``key`` tells rows of equal id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
                            F.xxhash64(text).alias("key"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def _starts(values: list[np.ndarray]) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns; the first row is True."""
    out = np.ones(len(values[0]), bool)
    out[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
    return out


def units(documents: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One row per unit: gram, digest, document and span.

    Where a batch has the unit earlier too, the strings are decided; those next to each other are one row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text", 2 * BATCH):
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
            order = np.lexsort((keys, ids))
            order = order[_starts([ids[order], keys[order]])] if len(order) else order
            ids, keys = ids[order], keys[order]
            for chunks in Chunks.of(raw(batch.column("text").take(pa.array(order)))):
                text, at, count, gram, digest = chunks.units(frequent)
                if not len(text):
                    continue
                rows = np.lexsort((digest, gram))
                again = np.empty(len(rows), bool)
                again[rows] = ~_starts([gram[rows], digest[rows]])
                # Decided units that follow each other become one.
                opens = np.ones(len(rows), bool)
                opens[1:] = ~(again[1:] & again[:-1] & (text[1:] == text[:-1]) & (at[1:] == at[:-1] + count[:-1]))
                span = at[opens] << _SHIFT | np.add.reduceat(count, np.flatnonzero(opens))
                text, again = text[opens], again[opens]
                # What is decided may go anywhere.
                yield {"gram": np.where(again, at[opens] * 7919 + ids[text], gram[opens]),
                       "digest": np.where(again, 0, digest[opens]),
                       "id": ids[text], "key": keys[text], "span": np.where(again, ~span, span)}

    return map_arrow(documents.select("id", "key", "text"), read, "gram long, digest long, id long, key long, span long")


def frequent_grams(documents: DataFrame) -> np.ndarray:
    """Grams that own units in many places of a sample."""
    share = min(1.0, SAMPLE / max(1, documents.count()))
    some = units(documents.sample(share, seed=1), np.empty(0, np.uint64)).filter("span >= 0")
    rows = some.groupBy("gram").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "gram").limit(FREQUENT)
    return np.array(sorted(r["gram"] for r in rows.toLocalIterator()), np.int64).view(np.uint64)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Decide copies among sorted units; gram is NULL in decided rows.

    Undecided rows are the first copies of units whose gram has several units. Whether the first unit of a
    gram is one of them shows with the next unit, so one row is held back from batch to batch.
    """
    last = held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        carried = [] if last is None else [last]
        gram, digest, id_, key, span = (
            np.concatenate([np.array([row[k] for row in carried], np.int64), batch.column(n).to_numpy()])
            for k, n in enumerate(("gram", "digest", "id", "key", "span")))
        opens = _starts([gram, digest])
        firsts = np.flatnonzero(opens)
        owner = firsts[np.cumsum(opens) - 1]
        # Strings of a row that repeats the first copy itself are no copies.
        decided = (span < 0) | (id_ != id_[owner]) | (key != key[owner]) | (span >> _SHIFT != span[owner] >> _SHIFT)
        decided[:len(carried)] = False
        # Units in order of their first copy, after the one held back.
        fresh = firsts[(span[firsts] >= 0) & (firsts >= len(carried))]
        rows = [c[fresh] for c in (id_, key, span, gram)]
        told = False
        if held is not None:
            rows, told = [np.append(h, c) for h, c in zip(held[0], rows, strict=True)], held[1]
        mixed = np.zeros(len(rows[0]), bool)
        if len(mixed):
            same = rows[3][1:] == rows[3][:-1]
            mixed = np.append(same, False) | np.append(told, same)
            held = [int(c[-1]) for c in rows], bool(mixed[-1])
            mixed[0] &= not told  # given out before
        gone = np.flatnonzero(decided)
        left = [id_[gone], key[gone], np.where(span[gone] < 0, span[gone], ~span[gone]), np.zeros(len(gone), np.int64)]
        out = [np.concatenate([a, b[mixed]]) for a, b in zip(left, rows, strict=True)]
        yield {"id": out[0], "key": out[1], "span": out[2], "gram": pa.array(out[3], mask=np.arange(len(out[3])) < len(gone))}
        # The unit at the end goes on with its first copy.
        last = tuple(int(c[owner[-1]]) for c in (gram, digest, id_, key, span))


def _packed(documents: DataFrame) -> DataFrame:
    """The same documents with compressed texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for batch in pieces(batches, "text", 2 * BATCH):
            yield {"id": batch.column("id"), "key": batch.column("key"), "doc_id": batch.column("doc_id"),
                   "packed": pa.array([squeeze.compress(t) for t in raw(batch.column("text"))], pa.binary())}

    return map_arrow(documents, pack, "id long, key long, doc_id long, packed binary")


def _texts(batches: Iterator[pa.RecordBatch], spans: str) -> Iterator[tuple[dict, bytes, pa.StructArray | None]]:
    """Row by row: the other columns, the text, and its list of spans."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("packed", spans)]
        for row, packed, found in zip(batch.select(names).to_pylist(), batch.column("packed"), batch.column(spans), strict=True):
            yield row, expand.decompress(packed.as_py()), found.values if found.is_valid else None


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The bytes of the wanted units of each text."""
    for row, text, wanted in _texts(batches, "wanted"):
        span = wanted.field("span").to_numpy()
        at, strings = span >> _SHIFT, span & _COUNT
        yield {"gram": wanted.field("gram"), "id": np.full(len(at), row["id"]), "key": np.full(len(at), row["key"]), "at": at,
               "unit": pa.array([text[a:b] for a, b in zip(at.tolist(), (at + strings + WIDTH - 1).tolist(), strict=True)], pa.binary())}


def _cut_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by gram in shards of about SHARD bytes, all units of a gram in one."""
    held, size, last = [], 0, None
    for batch in batches:
        while batch.num_rows:
            gram = batch.column("gram").to_numpy()
            total = size + np.cumsum([len(u) for u in raw(batch.column("unit"))])
            opens = np.append(gram[0] != last, gram[1:] != gram[:-1])
            before = np.append(size, total[:-1])
            cut = np.flatnonzero(opens & (before >= SHARD))
            last = int(gram[-1])
            if not len(cut):
                held.append(batch)
                size = int(total[-1])
                break
            held.append(batch.slice(0, cut[0]))
            yield held
            batch, held, size, last = batch.slice(cut[0]), [], 0, None
    if held:
        yield held


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for shard in _cut_shards(batches):
        with tempfile.TemporaryDirectory() as folder:
            yield from _repeats_in(shard, folder)


def _repeats_in(shard: list[pa.RecordBatch], folder: str) -> Iterator[dict]:
    """Spans of strings of one shard that occur earlier in it."""
    text, begins = Spool(folder, "text", np.int16, LIMIT), Spool(folder, "begins", np.int64, LIMIT)
    rows = [Spool(folder, n, np.int64, LIMIT) for n in ("id", "key", "at")]
    text.append(np.zeros(1, np.int16))
    for batch in shard:
        if not batch.num_rows:
            continue
        parts = raw(batch.column("unit"))
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
        lengths = np.array([len(p) for p in parts]) + 1
        data[np.cumsum(lengths) - 1] = 0
        begins.append(text.size + np.cumsum(lengths) - lengths)
        text.append(data)
        for spool, name in zip(rows, ("id", "key", "at"), strict=True):
            spool.append(batch.column(name).to_numpy())
    begin, (id_, key, at) = begins.array(), (spool.array() for spool in rows)
    covered = room(folder, "covered", bool, text.size, LIMIT)
    for places, common in sorted_suffixes(text.array(), 1, folder, LIMIT):
        long = common >= WIDTH
        equal = long | np.append(long[1:], False)
        places, opens = places[equal], ~long[equal]
        if not len(places):
            continue
        unit = np.searchsorted(begin, places, side="right") - 1
        group = np.cumsum(opens)
        where = at[unit] + places - begin[unit]
        order = np.lexsort((where, key[unit], id_[unit], group))
        place = [group[order], id_[unit[order]], key[unit[order]], where[order]]
        first = np.flatnonzero(_starts(place[:1]))[place[0] - place[0][0]]
        # Rows that repeat bring the earliest occurrence several times; it stays.
        later = np.any([v != v[first] for v in place[1:]], axis=0)
        covered[places[order[later]]] = True
    for start in range(0, text.size, BATCH):
        marked = np.flatnonzero(covered[start:start + BATCH])
        if not len(marked):
            continue
        opens = np.append(True, marked[1:] != marked[:-1] + 1)
        first = marked[opens]
        count = np.diff(np.append(np.flatnonzero(opens), len(marked)))
        unit = np.searchsorted(begin, start + first, side="right") - 1
        yield {"id": id_[unit], "key": key[unit], "span": ~((at[unit] + start + first - begin[unit]) << _SHIFT | count)}


def _cut(text: bytes, span: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed runs, and the digest of what is left."""
    span = np.sort(span)
    begin = span >> _SHIFT
    end = np.maximum.accumulate(begin + (span & _COUNT) + WIDTH - 1)
    if len(span):
        opens = np.append(True, begin[1:] > end[:-1])
        begin, end = begin[opens], end[np.append(opens[1:], True)]
    digest, here = hashlib.sha256(), 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        digest.update(text[here:a])
        here = b
    digest.update(text[here:])
    return int((end - begin).sum()), len(begin), digest.hexdigest()


def covered_strings(documents: DataFrame) -> DataFrame:
    """Spans of strings that start earlier as well: (id, key, span), complements of spans."""
    docs = _documents(documents)
    rows = units(docs, frequent_grams(docs))
    sorted_rows = rows.repartition("gram").sortWithinPartitions("gram", "digest", "id", "key", "span")
    settled = stage(map_arrow(sorted_rows, _settle, "id long, key long, span long, gram long"), "repeats")
    wanted = settled.filter("gram is not null").groupBy("id", "key").agg(F.collect_list(F.struct("span", "gram")).alias("wanted"))
    texts = _packed(docs).join(wanted, ["id", "key"]).select("id", "key", "packed", "wanted")
    found = map_arrow(texts, _bytes_of, "gram long, id long, key long, at long, unit binary")
    shards = map_arrow(found.repartition("gram").sortWithinPartitions("gram"), _sort_shards, "id long, key long, span long")
    return settled.filter("gram is null").drop("gram").unionByName(shards)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, and the digest of the remaining bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = []
        for row, text, found in _texts(batches, "found"):
            spans = ~found.field("span").to_numpy() if found is not None else np.empty(0, np.int64)
            held.append((row["doc_id"], len(text), *_cut(text, spans)))
            if len(held) == 1000:
                yield _columns(held)
                held = []
        if held:
            yield _columns(held)

    # The list of one span holds a struct, so that its column reads the same as in the other join.
    found = covered_strings(documents).groupBy("id", "key").agg(F.collect_list(F.struct("span")).alias("found"))
    texts = _packed(_documents(documents)).join(found, ["id", "key"], "left").select("doc_id", "packed", "found")
    return map_arrow(texts, read, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _columns(rows: list[tuple]) -> dict:
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return {n: pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
