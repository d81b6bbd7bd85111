"""Language identification by prediction by partial matching over bytes.

For each language a tree counts which byte follows which context of up to ``ORDER`` bytes, contexts
beginning with the word. Frozen, the trees give every byte a probability: from the longest context
that was seen, else through an escape (as many escapes as the context has successors, method C, successors
already ruled out excluded) to the next shorter one, down to a uniform byte. A text's code length
under a language is the sum over its words; the shortest wins, ties go to the first name.

Words are coded apart from each other, so the code lengths of a word are computed once per worker and
looked up afterwards, and the cost of a byte depends on its context alone.

Trees are fitted on a bounded sample: about ``SAMPLE`` documents for each language, chosen by a hash of
their ids. They are collected and broadcast, pruned to the ``CONTEXTS`` most frequent (context, byte)
counts of each language.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0, as is every text if nothing could be
learned; repeated rows are predicted each; an empty table gives an empty result. Further columns of
the input are not touched and may have any name.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtrail.llm.texts import BLANK, columns, map_arrow, pieces, raw

ORDER = 4
SAMPLE = 1500
CONTEXTS = 200_000
KNOWN_WORDS = 500_000
KNOWN_LENGTH = 64
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _training(docs: DataFrame, sample: int) -> DataFrame:
    """A sample of about ``sample`` documents of each language, by a hash that ignores the text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    # One row for each language comes to the driver; no text is moved to find the sample.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return known.select("lang", "text").limit(0)
    share = F.create_map(*chain.from_iterable((F.lit(r["lang"]), F.lit(sample / r["n"])) for r in sizes))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")


def context_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """How often a byte follows a context: (lang, context with the byte last, count)."""
    words = texts.select("lang", F.explode(F.split("text", BLANK)).alias("word")).filter("word <> ''").groupBy(
        "lang", "word").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: dict[tuple[str, bytes], int] = defaultdict(int)
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                body = b" " + word.encode().lower() + b" "
                for at in range(1, len(body)):
                    for begin in range(max(0, at - order), at + 1):
                        counts[lang, body[begin:at + 1]] += n
            if len(counts) > 1_000_000:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    rows = map_arrow(words, run, "lang string, gram binary, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(counts: dict) -> dict:
    return {"lang": pa.array([k[0] for k in counts], pa.string()), "gram": pa.array([k[1] for k in counts], pa.binary()),
            "n": pa.array(list(counts.values()), pa.int64())}


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
        sample: int = SAMPLE, contexts: int = CONTEXTS) -> dict[str, dict[bytes, int]]:
    """Counts by language; bounded by the sample and by ``contexts`` for each language."""
    rows = columns(docs, id=doc_id, text=text, lang=lang)
    counts = context_counts(_training(rows, sample), order)
    top = counts.withColumn("_r", F.row_number().over(
        W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).filter(F.col("_r") <= contexts)
    model: dict[str, dict[bytes, int]] = defaultdict(dict)
    for row in top.select("lang", "gram", "n").toLocalIterator():
        model[row["lang"]][bytes(row["gram"])] = row["n"]
    return dict(model)


class Trees(dict):
    """Code lengths in bits of words, a row for each known word and a column for each language."""

    def __init__(self, model: dict[str, dict[bytes, int]], order: int):
        self.langs = sorted(model)
        self.order = order
        self.next: list[dict[bytes, dict[int, int]]] = []
        for lang in self.langs:
            tree: dict[bytes, dict[int, int]] = defaultdict(dict)
            for gram, n in model[lang].items():
                tree[gram[:-1]][gram[-1]] = n
            self.next.append(dict(tree))
        self.costs: dict[bytes, tuple[float, ...]] = {}
        self.table = np.zeros((1024, len(self.langs)))
        self.used = 0

    def bits(self, tree: dict[bytes, dict[int, int]], context: bytes, byte: int) -> float:
        """Code length of a byte in a context: escapes until a context has seen it."""
        total, excluded = 0.0, set()
        for start in range(len(context) + 1):
            seen = tree.get(context[start:])
            if not seen:
                continue
            live = {b: n for b, n in seen.items() if b not in excluded} if excluded else seen
            weight = sum(live.values())
            if byte in live:
                return total - math.log2(live[byte] / (weight + len(live)))
            if live:
                total -= math.log2(len(live) / (weight + len(live)))
                excluded |= live.keys()
        return total + math.log2(256 - len(excluded))

    def _cost(self, gram: bytes) -> tuple[float, ...]:
        if len(self.costs) >= KNOWN_WORDS:
            self.costs.clear()
        cost = self.costs[gram] = tuple(self.bits(t, gram[:-1], gram[-1]) for t in self.next)
        return cost

    def word_bits(self, word: bytes) -> list[float]:
        body, order, known = b" " + word.lower() + b" ", self.order, self.costs
        rows = []
        for at in range(1, len(body)):
            gram = body[max(0, at - order):at + 1]
            rows.append(known.get(gram) or self._cost(gram))
        return [math.fsum(column) for column in zip(*rows)]

    def __missing__(self, word: bytes) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.word_bits(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def text_bits(self, text: bytes) -> np.ndarray:
        """Code length of a text under every language."""
        words = text.split()
        if self.used > KNOWN_WORDS:
            self.clear()
            self.used = 0
        total = np.zeros(len(self.langs))
        for start in range(0, len(words), 4096):
            part = words[start:start + 4096]
            long = [w for w in part if len(w) > KNOWN_LENGTH]
            if long:
                part = [w for w in part if len(w) <= KNOWN_LENGTH]
                for w in long:
                    total += self.word_bits(w)
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            total += self.table[at].sum(0)
        return total


_trees: dict[int, Trees] = {}


def predict(docs: DataFrame, model: dict[str, dict[bytes, int]], doc_id: str = "doc_id", text: str = "text",
            order: int = ORDER) -> DataFrame:
    """Language and score, the posterior under equal priors, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model, order))
    rows = columns(docs, id=doc_id, text=text).select("id", "text", held_out(F.col("id")).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        if number not in _trees:
            _trees.clear()
            _trees[number] = Trees(*shared.value)
        trees = _trees[number]
        for batch in pieces(batches, "text"):
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_pylist()
            names, scores = [], []
            for body, readable in zip(raw(batch.column("text")), letters):
                if not readable or not trees.langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bits = trees.text_bits(body)
                best = int(bits.argmin())
                names.append(trees.langs[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
            yield {doc_id: batch.column("id"), "held_out": batch.column("held_out"),
                   "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return map_arrow(rows, run, f"{doc_id} {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return predict(docs, fit(docs, doc_id, text, lang), doc_id, text)
