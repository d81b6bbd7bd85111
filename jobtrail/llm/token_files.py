"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are put in ascending order by a range partitioning, encoded, and packed into shards of
about ``SHARD_TOKENS`` ids. In a shard the frequent pairs of adjacent ids become nonterminals, over
and over, until no pair is left that occurs ``LEAST_COUNT`` times: each round counts all pairs, takes the most
frequent ones and replaces them, the more frequent first where two overlap and every second one of a
run of one id. Rules that replaced nothing are not stored. What is stored per shard:

* ``rules``: two symbols for each nonterminal, which are numbered from ``first`` on;
* ``lengths``: how many ids each nonterminal expands to;
* ``symbols``: the replaced sequence, and ``marks``: the ids before every ``MARK``-th symbol, so
  that a range of ids is decoded without its neighbours;
* ``ids``, ``counts``: document ids and their numbers of tokens, end id included.

A shard is a row of a Parquet table with binary columns, written and read by Spark, so it can
lie in any store. Numbers are little-endian unsigned, two bytes each where all symbols fit.

Defined cases: NULL and empty texts hold the end id alone; NULL ids come first; rows that repeat an
id are all stored, in the order of their texts; an empty table gives no shard. Further columns of the
input are not touched and may have any name.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtrail.llm.bpe import byte_symbols, definition
from jobtrail.llm.texts import columns, map_arrow, pieces
from jobtrail.session import scratch_path

END = 1
SHARD_TOKENS = 1 << 20
RULES_A_ROUND = 16_000
LEAST_COUNT = 8
MARK = 1024
KNOWN_WORDS = 1_000_000
#: Signs that may follow a word of letters, in one run, and how many runs are kept.
SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
KNOWN_SIGNS = 10_000


class LibraryEncoder:
    """Ids from the tokenizers library.

    A tokenizer that lower-cases, splits at white space and works on bytes is asked once for each white-space
    delimited word, since no word's ids depend on its neighbours; a word of letters with signs after them goes
    straight to its merge model. Arrow finds the different words of a call, lower-cases those of ASCII letters and cuts off their
    signs, so that what is looked up and remembered is a body or a run of signs. Any other tokenizer is asked for whole texts.
    Beyond ``KNOWN_WORDS`` words the table starts afresh, which bounds its memory.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_word = _splits_words(json.loads(spec))
        self.symbols = dict(enumerate(byte_symbols()))
        self.tokenize = self.tokenizer.model.tokenize
        self.signs: dict[str, list[int]] = {}
        self._fresh()

    def _fresh(self) -> None:
        """Number of each known word, and the ids of word k: ``lengths[k]`` of them from ``starts[k]``."""
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _plain(self, word: str, bodies: dict[str, list[int]]) -> list[int] | None:
        """Ids of letters with signs after them, None for other words; ``bodies`` has the letters met before."""
        body = word.rstrip(SIGNS)
        if not body.isalpha():
            return None
        if (ids := bodies.get(body)) is None:
            # One letter at a time where the place in the word could matter.
            inner = "".join([c.lower() for c in body]) if "\u03a3" in body else body.lower()
            if not inner.isalpha() or not unicodedata.is_normalized("NFC", inner) or not unicodedata.is_normalized("NFC", body):
                return None
            ids = bodies[body] = [t.id for t in self.tokenize(inner.encode().decode("latin-1").translate(self.symbols))]
        if len(body) == len(word):
            return ids
        signs = word[len(body):]
        if (after := self.signs.get(signs)) is None:
            after = [t.id for t in self.tokenize(signs)]
            if len(self.signs) < KNOWN_SIGNS:
                self.signs[signs] = after
        return ids + after

    def _learn(self, words: list[bytes]) -> None:
        """Take up different unknown words; they are numbered in a row."""
        tokenize, bodies = self.tokenize, {}
        found = [[t.id for t in tokenize(w.lower().decode())] if w.isalpha() else self._plain(w.decode(), bodies) for w in words]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for start in range(0, len(rest), 10_000):
            part = rest[start:start + 10_000]
            coded = self.tokenizer.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False)
            for i, c in zip(part, coded):
                found[i] = c.ids
        first = len(self.known)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self.ids = _room(self.ids, self.used + len(flat))
        self.starts, self.lengths = _room(self.starts, first + len(found)), _room(self.lengths, first + len(found))
        self.ids[self.used:self.used + len(flat)] = flat
        self.lengths[first:first + len(found)] = lengths
        self.starts[first:first + len(found)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.known.update(zip(words, range(first, first + len(found))))

    def _numbers(self, parts: list[bytes]) -> np.ndarray:
        """Numbers of different words, the unknown ones learnt first."""
        at = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        missed = np.flatnonzero(at < 0)
        if len(missed) and len(self.known) + len(missed) > KNOWN_WORDS:
            self._fresh()
            missed = np.arange(len(parts))
        if len(missed):
            at[missed] = len(self.known) + np.arange(len(missed))
            self._learn([parts[i] for i in missed.tolist()])
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text, the end id included."""
        if not self.by_word:
            coded = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return [np.array(c.ids + [END], np.uint32) for c in coded]
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        every = split.flatten().dictionary_encode()
        of_part, names = _parts(every.dictionary)
        at = self._numbers(names)[of_part]
        # The ids of the different words in a row, and from them those of all words.
        lengths = self.lengths[at].reshape(-1, 2).sum(1)
        words = expand(at, (self.ids, self.starts, self.lengths)), np.cumsum(lengths) - lengths, lengths
        which = every.indices.to_numpy()
        flat = expand(which, words)
        ends = np.concatenate(([0], np.cumsum(lengths[which])))
        counts = pc.list_value_length(split).to_numpy()
        borders = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [np.append(flat[a:b], np.uint32(END)) for a, b in zip(borders, borders[1:])]


def _parts(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Two parts of every word, as numbers of the different parts: a body of ASCII letters in lower case and the
    signs after it, or any other word as a whole and nothing."""
    if not len(words):
        return np.empty(0, np.int64), []
    body = pc.ascii_rtrim(words, characters=SIGNS)
    plain = pc.ascii_is_alpha(body)
    words = pc.if_else(plain, pc.ascii_lower(words), words)
    borders = np.empty(2 * len(words) + 1, np.int64)
    borders[::2] = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    borders[1::2] = np.where(plain.to_numpy(zero_copy_only=False), borders[:-1:2] + pc.binary_length(body).to_numpy(), borders[2::2])
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), 2 * len(words), [None, pa.py_buffer(borders), words.buffers()[2]]).dictionary_encode()
    return parts.indices.to_numpy(), parts.dictionary.to_pylist()


def _room(values: np.ndarray, size: int) -> np.ndarray:
    return values if size <= len(values) else np.concatenate([values, np.zeros(max(size, len(values)), values.dtype)])


def _splits_words(spec: dict) -> bool:
    """Whether texts fall apart at white space, in lower case and bytes."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        and "[\\p{L}]+" in parts[0]["pattern"].get("Regex", "").split("|")
        and "[^\\s\\p{L}\\p{N}]+" in parts[0]["pattern"].get("Regex", "").split("|")
    )


_encoders: dict[int, LibraryEncoder] = {}


def _encoder(spec: str) -> LibraryEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(spec)
    return _encoders[key]


def _frequent(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur LEAST_COUNT times, and of these the most frequent in order of rank, no two of them in one slot."""
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero(counts >= LEAST_COUNT)
    frequent = ordered[starts[often]]
    slots = _slot(frequent)
    # Equal counts go in the order of a hash: in the order of ids, chains of pairs would shadow each other.
    order = np.lexsort((slots, -counts[often]))[:most]
    _, first = np.unique(slots[order], return_index=True)
    return frequent, frequent[order[np.sort(first)]]


def _slot(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(12)).astype(np.int32)
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int32)


def compress(ids: np.ndarray, first: int, most: int = RULES_A_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k makes symbol ``first + k`` of two earlier symbols.

    Each round replaces the most frequent pairs, where pairs overlap the more frequent one, and of a run
    of equal ids every second pair; rounds go on until no pair occurs LEAST_COUNT times. A pair of earlier symbols never becomes
    more frequent, so a round looks only at pairs that were frequent before it and at those with a symbol made in the last one.
    """
    # Inside, symbols are numbered without gaps, so that keys of pairs stay narrow for longer.
    met = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
    number = np.zeros(int(met[-1]) + 1 if len(met) else 0, np.uint32)
    number[met] = np.arange(len(met))
    seq = number[ids]
    rules: list[np.ndarray] = []
    made, base = 0, len(met)
    nothing = np.iinfo(np.int32).max
    # Of each slot: 0 without frequent keys, 1 with some, 2 and more for the key taken.
    slots = np.zeros(1 << 20, np.int32)
    live = np.arange(max(0, len(seq) - 1))
    while len(live) >= LEAST_COUNT:
        shift, kind = (16, np.uint32) if base + made <= 1 << 16 else (32, np.uint64)
        keys = seq[live].astype(kind) << kind(shift) | seq[live + 1]
        frequent, chosen = _frequent(keys, most)
        if not len(chosen):
            break
        used = _slot(frequent)
        slots[used] = 1
        slots[_slot(chosen)] = np.arange(2, len(chosen) + 2, dtype=np.int32)
        at = slots[_slot(keys)]
        slots[used] = 0
        found = np.flatnonzero((at > 1) & (np.concatenate((chosen[:1], chosen[:1], chosen))[at] == keys))
        hits, value = live[found], at[found] - 2
        live = live[np.flatnonzero(at)]
        # A pair is taken where both its neighbours rank lower.
        joined = hits[1:] == hits[:-1] + 1
        before, after = np.full((2, len(hits)), nothing, np.int32)
        np.copyto(before[1:], value[:-1], where=joined)
        np.copyto(after[:-1], value[1:], where=joined)
        wins = (value < before) & (value < after)
        # Runs of one score are pairs of one id with itself; of a run that is taken every second pair is.
        same = np.zeros(len(hits) + 1, bool)
        same[1:-1] = joined & (value[1:] == value[:-1])
        if same.any():
            begin, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
            taken = (value[begin] < before[begin]) & (value[begin] < after[last])
            size = (last - begin + 2)[taken] // 2
            ends = np.cumsum(size)
            wins[np.repeat(begin[taken] - 2 * (ends - size), size) + 2 * np.arange(size.sum())] = True
        won = np.flatnonzero(wins)
        places, value = hits[won], value[won]
        taken = np.zeros(len(chosen), bool)
        taken[value] = True
        pairs = chosen[taken]
        rules.append(np.stack([pairs >> kind(shift), pairs & kind((1 << shift) - 1)], 1).astype(np.uint32))
        seq[places] = base + made + (np.cumsum(taken) - 1)[value]
        made += len(pairs)
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        again = np.zeros(len(seq), bool)
        again[live] = True
        again[places] = True
        again[places[places > 0] - 1] = True
        seq = seq[keep]
        live = np.flatnonzero(again[keep][:-1])
    back = np.concatenate([met, first + np.arange(made)]).astype(np.uint32)
    return back[np.concatenate(rules)] if rules else np.empty((0, 2), np.uint32), back[seq]


def _blocks(rules: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules that name symbols before the range only."""
    highest = np.maximum.accumulate(rules.max(1)) if len(rules) else rules
    start = 0
    while start < len(rules):
        stop = max(start + 1, int(np.searchsorted(highest, first + start)))
        yield start, stop
        start = stop


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids every symbol below ``first + len(rules)`` expands to."""
    lengths = np.ones(first + len(rules), np.int64)
    for a, b in _blocks(rules, first):
        lengths[first + a:first + b] = lengths[rules[a:b]].sum(1)
    return lengths


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths) of what every symbol below ``first + len(rules)`` expands to."""
    lengths = rule_lengths(rules, first)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    flat[:first] = np.arange(first)
    for a, b in _blocks(rules, first):
        flat[starts[first + a]:ends[first + b - 1]] = expand(rules[a:b].ravel(), (flat, starts, lengths))
    return flat, starts, lengths


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What the symbols expand to, one after the other."""
    flat, starts, lengths = table
    if not len(symbols):
        return np.empty(0, np.uint32)
    size = lengths[symbols]
    ends = np.cumsum(size)
    return flat[np.repeat(starts[symbols] - (ends - size), size) + np.arange(ends[-1])]


SHARD = ("part int, number int, before long, n_tokens long, first int, width int, rules binary, lengths binary, "
         "symbols binary, marks binary, ids {kind}, counts array<int>")


def _shard(part: int, number: int, before: int, ids: list, tokens: list[np.ndarray], first: int, kind: pa.DataType) -> dict:
    seq = np.concatenate(tokens)
    rules, symbols = compress(seq, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    number_of = rule_lengths(rules, first)
    marks = (np.cumsum(number_of[symbols]) - number_of[symbols])[::MARK]
    one = {"part": part, "number": number, "before": before, "n_tokens": len(seq), "first": first, "width": width,
           "rules": rules.astype(f"<u{width}").tobytes(), "lengths": number_of[first:].astype("<u4").tobytes(),
           "symbols": symbols.astype(f"<u{width}").tobytes(), "marks": marks.astype("<u4").tobytes()}
    kinds = {"part": pa.int32(), "number": pa.int32(), "before": pa.int64(), "n_tokens": pa.int64(),
             "first": pa.int32(), "width": pa.int32()}
    out = {k: pa.array([v], kinds.get(k, pa.binary())) for k, v in one.items()}
    return out | {"ids": pa.array([ids], pa.list_(kind)), "counts": pa.array([[len(t) for t in tokens]], pa.list_(pa.int32()))}


def write_shards(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all documents and write their shards, in ascending order of ids, to ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(definition(tokenizer))
    rows = columns(docs, id=doc_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    # Ties go by text, so rows that repeat an id keep one order whatever task they come from.
    ordered = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("id", "_tie").sortWithinPartitions(
        "id", "_tie", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(shared.value)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, tokens, size, id_type = [], [], 0, None
        for batch in pieces(batches, "text"):
            id_type = batch.column("id").type
            for name, coded in zip(batch.column("id").to_pylist(), encoder.encode(batch.column("text"))):
                ids.append(name)
                tokens.append(coded)
                size += len(coded)
                if size >= shard_tokens:
                    yield _shard(part, number, before, ids, tokens, encoder.size, id_type)
                    number, before = number + 1, before + size
                    ids, tokens, size = [], [], 0
        if ids:
            yield _shard(part, number, before, ids, tokens, encoder.size, id_type)

    map_arrow_shards(ordered, run, kind).write.parquet(path)


def map_arrow_shards(df: DataFrame, run, kind: str) -> DataFrame:
    schema = SHARD.format(kind=f"array<{kind}>")
    names = [f.split()[0] for f in schema.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(it):
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return df.mapInArrow(batches, schema)


def _numbers(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}")


def decode_shard(shard: dict) -> np.ndarray:
    """All ids of a shard."""
    rules = _numbers(shard["rules"], shard["width"]).reshape(-1, 2)
    return expand(_numbers(shard["symbols"], shard["width"]), expansions(rules, shard["first"]))


def decode_range(shard: dict, start: int, stop: int) -> list[int]:
    """Ids ``start`` to ``stop`` of a shard; symbols before the last mark are not looked at, and of
    the rules only those that are met."""
    first, width = shard["first"], shard["width"]
    rules = _numbers(shard["rules"], width).reshape(-1, 2)
    lengths, symbols = _numbers(shard["lengths"], 4), _numbers(shard["symbols"], width)
    marks = _numbers(shard["marks"], 4)
    block = max(0, int(np.searchsorted(marks, start, "right")) - 1)
    at, place = int(marks[block]) if len(marks) else 0, block * MARK
    out: list[int] = []
    stack: list[int] = []
    while at < stop and (stack or place < len(symbols)):
        if stack:
            symbol = stack.pop()
        else:
            symbol, place = int(symbols[place]), place + 1
        size = int(lengths[symbol - first]) if symbol >= first else 1
        if at + size <= start:
            at += size
        elif symbol >= first:
            left, right = rules[symbol - first].tolist()
            stack += [right, left]
        else:
            out.append(symbol)
            at += 1
    return out


def read_shards(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """Per document: position of its first id in the whole, number of ids, and their CRC-32."""
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard = batch.slice(at, 1).to_pylist()[0]
                ids = decode_shard(shard).astype("<u4")
                ends = np.cumsum(np.array(shard["counts"], np.int64))
                starts = ends - shard["counts"]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield {"id": pa.array(shard["ids"], batch.schema.field("ids").type.value_type),
                       "part": pa.array([shard["part"]] * len(crc), pa.int32()),
                       "start": pa.array(starts + shard["before"]), "n": pa.array(ends - starts), "crc": pa.array(crc, pa.int64())}

    rows = map_arrow(shards, run, f"id {kind}, part int, start long, n long, crc long")
    # One row for each part of the range partitioning, however many documents there are.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(parts, "part").select(
        F.col("id").alias(doc_id), (F.col("start") + F.col("_before")).alias("start"),
        F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def pack_and_read(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards to the shared folder and report from the files."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer, doc_id, text)
    return read_shards(docs.sparkSession, path, doc_id)
