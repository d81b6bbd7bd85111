"""BPE as a deterministic automaton over tokens.

The automaton starts as one state with a loop for every base symbol. Each merge (u, v) -> w, in
order, applies one gadget: every state with a ``u`` arc gains a ``w`` arc into a clone of the state
behind ``v``, and the state behind ``u`` loses its ``v`` arc. All arcs with one label enter one
state, so there is one state for each label and the start. The automaton accepts exactly the token
sequences that merging in order would leave, and each word has exactly one such sequence.

A clone is kept as its origin and the merge that made it, an arc as the merge that barred it;
whether a state has an arc follows from these and is looked up in a transition table afterwards. Encoding a
pre-split word follows arcs, the longest label first; a position from which no arc leads on is
left for good, so a word takes time in proportion to its length. Decoding emits the arc labels.

Defined cases: NULL and empty texts have no ids; very long words are encoded like others but not
kept in the table of known words; repeated rows are encoded each; an empty table gives an empty
result. Further columns of the input are not touched and may have any name.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from jobtrail.llm.texts import columns, map_arrow, pieces, raw

#: Words a worker remembers; beyond that the older half goes, which bounds its memory.
KNOWN_WORDS = 100_000
KNOWN_LENGTH = 64


class MergeAutomaton:
    """Tokens are numbers; ``merges`` are (left, right, product) in order. The state behind a token
    has the token's number; the start has arcs with every label."""

    def __init__(self, merges: Iterable[tuple[int, int, int]], tokens: int):
        self.born, self.left, self.right = [-1] * tokens, [-1] * tokens, [-1] * tokens
        self.barred: dict[int, int] = {}
        #: The transition table as far as it was used: state and label in one number.
        self.arcs: dict[int, bool] = {}
        for time, (u, v, w) in enumerate(merges):
            # The new label's state starts as the state behind v is now; then u loses its v arc.
            self.born[w], self.left[w], self.right[w] = time, u, v
            self.barred[u << 20 | v] = time

    def _has(self, state: int, label: int, time: int) -> bool:
        """Whether the state has an arc with the label after the gadgets up to ``time``."""
        born, barred = self.born, self.barred
        while barred.get(state << 20 | label, time + 1) > time:
            if born[state] > born[label]:  # an older label: as in the state this one began as
                state, time = self.right[state], born[state] - 1
            elif born[label] < 0:
                return True
            else:  # a younger label: there if its left part was when it came
                label, time = self.left[label], born[label]
        return False

    def allows(self, state: int, label: int) -> bool:
        key = state << 20 | label
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > 2 * KNOWN_WORDS:
                self.arcs.clear()
            known = self.arcs[key] = self._has(state, label, 1 << 60)
        return known


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable and not a
    space, else the next character from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec(dict):
    """Ids of white-space delimited words, for a tokenizer file with byte symbols, word ends,
    lower case and a split pattern. The dict holds words met so far."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = self.vocab
        count = max([*vocab.values(), *self.special.values()]) + 1
        self.automaton = MergeAutomaton(((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), count)
        self.labels = [""] * count
        for label, number in chain(vocab.items(), self.special.items()):
            self.labels[number] = label
        self.numbers = [str(i) for i in range(count)]
        self._symbols = byte_symbols()
        self._tables()
        self._old: dict[bytes, tuple[int, ...]] = {}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._split = regex.compile(pattern)
        self._marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _tables(self) -> None:
        """Byte transitions over all labels: ``_step`` leads on, ``_inner`` and ``_final`` name the
        label that ends at a node inside a word and at its end."""
        self._step: dict[int, int] = {}
        self._inner, self._final = [-1], [-1]
        self._width = [0] * len(self.labels)
        value = {s: b for b, s in enumerate(self._symbols)}
        for label, number in self.vocab.items():
            ends = bool(self.end) and label.endswith(self.end)
            node, body = 0, label[:-len(self.end)] if ends else label
            for symbol in body:
                key = node << 8 | value[symbol]
                node = self._step.get(key)
                if node is None:
                    node = self._step[key] = len(self._inner)
                    self._inner.append(-1)
                    self._final.append(-1)
            (self._final if ends or not self.end else self._inner)[node] = number
            if not self.end:
                self._inner[node] = number
            self._width[number] = len(body)

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        ids = self._old.get(word)
        if ids is None:
            ids = tuple(self._word(word.decode()))
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:  # words met since the last time stay within reach
                self._old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _word(self, word: str) -> list[int]:
        ids: list[int] = []
        for part in self._marks.split(word) if self._marks else [word]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            text = unicodedata.normalize("NFC", part)
            text = text.lower() if text.isascii() else "".join([c.lower() for c in text])
            for piece in self._split.findall(text):
                ids += self.path(piece.encode())
        return ids

    def path(self, word: bytes) -> list[int]:
        """Labels of the accepted path that spells a word and its end."""
        step, inner, final = self._step, self._inner, self._final
        machine = self.automaton
        allows, known = machine.allows, machine.arcs
        size, here, state = len(word), 0, -1
        out: list[int] = []
        choices: list[list[tuple[int, int]]] = []
        dead = set()
        arcs = None
        while here < size:
            if arcs is None:  # all labels that the word continues with, the longest last
                arcs, node, at = [], 0, here
                while at < size:
                    node = step.get(node << 8 | word[at])
                    if node is None:
                        break
                    at += 1
                    label = inner[node] if at < size else final[node]
                    if label >= 0:
                        arcs.append((at, label))
            while arcs:
                stop, label = arcs.pop()
                allowed = state < 0 or known.get(state << 20 | label)
                if allowed is None:
                    allowed = allows(state, label)
                if allowed and stop not in dead:
                    out.append(label)
                    choices.append(arcs)
                    here, state, arcs = stop, label, None
                    break
            else:
                if not out:
                    raise ValueError(f"no token for {word!r}")
                dead.add(here)
                out.pop()
                arcs = choices.pop()
                state = out[-1] if out else -1
                here = sum(map(self._width.__getitem__, out))
        return out

    def encode(self, text: bytes | None) -> list[int]:
        """Ids of a UTF-8 text. No pattern reaches over ASCII white space, so words are independent."""
        return list(chain.from_iterable(map(self.__getitem__, text.split()))) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))

    def spelled(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.numbers.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(definition: str) -> Codec:
    """One automaton per Python worker."""
    key = hashlib.md5(definition.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(definition)
    return _codecs[key]


def definition(path: str, limit: int = 64 << 20) -> str:
    """A tokenizer file, which goes to the executors and is bounded for that."""
    with open(path, encoding="utf-8") as file:
        text = file.read(limit + 1)
    if len(text) > limit:
        raise ValueError(f"{path} holds more than {limit} characters")
    return text


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, make, schema: str) -> DataFrame:
    rows = columns(docs, id=doc_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(definition(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = codec(shared.value)
        for batch in pieces(batches, "text"):
            yield {doc_id: batch.column("id"), **make(known, raw(batch.column("text")))}

    return map_arrow(rows, run, f"{doc_id} {kind}, {schema}")


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids`` of every document."""
    return _mapped(
        docs, path, doc_id, text,
        lambda c, texts: {"ids": pa.array([c.encode(t) for t in texts], pa.list_(pa.int32()))}, "ids array<int>")


def decode_documents(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``text`` of every row of ids; NULL ids give an empty text."""
    rows = columns(encoded, id=doc_id, ids=ids)
    kind = rows.schema["id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(definition(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = codec(shared.value)
        for batch in batches:
            texts = [known.decode(row or []) for row in batch.column("ids").to_pylist()]
            yield {doc_id: batch.column("id"), "text": pa.array(texts, pa.string())}

    return map_arrow(rows, run, f"{doc_id} {kind}, text string")


def _digests(known: Codec, texts: list[bytes | None], with_ids: bool) -> dict:
    counts, ids_sha, decoded_sha, kept = [], [], [], []
    for body in texts:
        ids = known.encode(body)
        counts.append(len(ids))
        ids_sha.append(hashlib.sha256(known.spelled(ids).encode()).hexdigest())
        decoded_sha.append(hashlib.sha256(known.decode(ids).encode()).hexdigest())
        if with_ids:
            kept.append(np.array(ids, np.int32))
    out = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()),
           "decoded_sha256": pa.array(decoded_sha, pa.string())}
    return out | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if with_ids else {})


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode, and digest both, in one pass; ``with_ids`` also returns the ids."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _mapped(docs, path, doc_id, text, lambda c, texts: _digests(c, texts, with_ids), schema)
