"""Quality classifier from weak labels.

``LABELLERS`` are overlapping heuristics that vote good (1), bad (-1) or abstain (0) on every document.
Expectation-maximisation over the counts of all vote patterns estimates how often each heuristic
gives each vote for good and for bad documents, and the share of good ones. The posterior of its
pattern labels a document, and a bounded sample of labelled documents (about ``SAMPLE``) trains a linear scorer over
hashed words and word shapes, which then scores every whole text.

Vote patterns number at most 3 to the power of the heuristics, whatever the corpus; they and the sample are all that
reaches the driver.

Defined cases: a text that is NULL or has no word gets votes of 0, score 0 and is not kept; repeated rows are scored
each; an empty table gives an empty result. Further columns of the input are not touched and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.quality_rules import words_of
from jobtrail.llm.texts import columns, let, map_arrow, pieces, raw
from jobtrail.session import stage

SAMPLE = 6000
BUCKETS = 1 << 14
ROUNDS = 60
STEPS = 300
KEEP = 0.5
#: A word of letters with at most one sign after it.
PLAIN = r"^\p{L}+[.,;:?!]?$"
KNOWN_WORDS = 500_000


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _measures(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return let(words_of(text), lambda w: F.struct(
        F.size(w).alias("words"),
        F.size(F.array_distinct(w)).alias("kinds"),
        F.length(F.array_join(w, "")).alias("chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>~^_=", ""))).alias("symbols"),
        (F.length(text) - F.length(F.translate(text, ".", ""))).alias("stops"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).alias("shouts"),
        F.size(F.filter(w, lambda x: x.rlike(PLAIN))).alias("plain"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))).alias("runs"),
        letters.alias("letters"), upper.alias("upper"),
        let(F.filter(F.split(text, "\n", -1), lambda x: x != ""), lambda a: F.struct(
            F.size(a).alias("all"), F.size(F.array_distinct(a)).alias("kinds"))).alias("lines")))


#: Name of each heuristic and its vote on the measures of a document with words.
LABELLERS = {
    "symbols": lambda m: _vote(m["symbols"] * 20 > m["words"] * 4, m["symbols"] * 50 < m["words"]),
    "capitals": lambda m: _vote(m["upper"] * 2 > m["letters"], m["upper"] * 6 < m["letters"]),
    "variety": lambda m: _vote(m["kinds"] * 4 < m["words"], m["kinds"] * 5 > m["words"] * 2),
    "runs": lambda m: _vote(m["runs"] * 5 > m["words"], m["runs"] * 50 <= m["words"]),
    "shouting": lambda m: _vote(m["shouts"] * 10 > m["words"], m["shouts"] * 100 <= m["words"]),
    "sentences": lambda m: _vote((m["stops"] * 80 < m["words"]) | (m["stops"] > m["words"]),
                                 (m["stops"] * 25 >= m["words"]) & (m["stops"] * 2 < m["words"])),
    "word_length": lambda m: _vote((m["chars"] < m["words"] * 2) | (m["chars"] > m["words"] * 14),
                                   (m["chars"] >= m["words"] * 3) & (m["chars"] <= m["words"] * 9)),
    "lines": lambda m: _vote(m["lines"]["kinds"] * 2 < m["lines"]["all"], m["lines"]["kinds"] == m["lines"]["all"]),
    "letters": lambda m: _vote(m["letters"] * 100 < m["chars"] * 94, m["letters"] * 100 >= m["chars"] * 96),
    "plain_words": lambda m: _vote(m["plain"] * 10 < m["words"] * 8, m["plain"] * 10 >= m["words"] * 9),
}


def votes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text`` and the votes of the heuristics in their order."""
    rows = columns(docs, id=doc_id, text=text).withColumn("_m", _measures(F.coalesce("text", F.lit(""))))
    cast = [F.when(F.col("_m.words") > 0, fn(F.col("_m"))).otherwise(0).cast("byte") for fn in LABELLERS.values()]
    return rows.select("id", "text", F.array(*cast).alias("votes"))


class LabelModel:
    """P(vote | class) of every labeller and the share of good documents."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
        one_hot = np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float)
        # A heuristic looks for one fault: it seldom finds it in good documents and misses most
        # other faults. Starting there also tells the two classes apart.
        self.table = np.tile(np.array([[0.3, 0.1, 0.6], [0.02, 0.13, 0.85]])[:, None, :], (1, patterns.shape[1], 1))
        self.prior = np.array([0.15, 0.85])
        for _ in range(rounds if len(counts) else 0):
            weight = self._posterior(one_hot) * counts[:, None]
            sums = np.einsum("pc,plv->clv", weight, one_hot) + np.array([0.1, 0.1, 0.1])
            self.table = sums / sums.sum(-1, keepdims=True)
            self.prior = (weight.sum(0) + 1) / (counts.sum() + 2)

    def _posterior(self, one_hot: np.ndarray) -> np.ndarray:
        log = np.log(self.prior) + np.einsum("plv,clv->pc", one_hot, np.log(self.table))
        likely = np.exp(log - log.max(1, keepdims=True))
        return likely / likely.sum(1, keepdims=True)

    def good(self, patterns: np.ndarray) -> np.ndarray:
        """Posterior of good for each vote pattern."""
        return self._posterior(np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float))[:, 1]


_SHAPE = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0")]


def shape(word: bytes) -> bytes:
    """A word with runs of lower case, upper case and digits as one sign each."""
    if word.isalpha() and word.islower():
        return b"a"
    for pattern, sign in _SHAPE:
        word = pattern.sub(sign, word)
    return word[:8]


def _places(word: bytes) -> tuple[int, int]:
    return zlib.crc32(word.lower()) % BUCKETS, BUCKETS + zlib.crc32(shape(word)) % 1024


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: places and shares of words; the last place counts words that
    follow themselves."""
    words = text.split() if text else []
    places = [p for w in words for p in _places(w)]
    places += [BUCKETS + 1024] * sum(a == b for a, b in zip(words, words[1:]))
    at, counts = np.unique(np.array(places, np.int32), return_counts=True)
    return at.astype(np.int32), counts / max(1, len(words))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = STEPS) -> np.ndarray:
    """Logistic regression on soft labels by full gradients; the last weight is the bias."""
    size = BUCKETS + 1026
    weights = np.zeros(size)
    if not rows:
        return weights
    at = np.concatenate([np.append(r[0], size - 1) for r in rows])
    value = np.concatenate([np.append(r[1], 1.0) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) + 1 for r in rows])
    goal = np.array([r[2] for r in rows])
    # Either class weighs the same, so a rare one is learned as well.
    balance = np.where(goal >= 0.5, 0.5 / max(goal.mean(), 1e-3), 0.5 / max(1 - goal.mean(), 1e-3))
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        guess = 1 / (1 + np.exp(-np.bincount(row, value * weights[at], len(rows))))
        slope = np.bincount(at, ((guess - goal) * balance)[row] * value, size) / len(rows) + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        weights -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    return weights


class Scorer(dict):
    """Weight of every word met so far, its shape included."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        weight = float(sum(self.weights[p] for p in _places(word)))
        if len(word) <= 64:
            self[word] = weight
        return weight

    def score(self, text: bytes | None) -> float:
        words = text.split() if text else []
        if not words:
            return 0.0
        total = sum(map(self.__getitem__, words)) + self.weights[-2] * sum(a == b for a, b in zip(words, words[1:]))
        return float(1 / (1 + np.exp(-np.clip(total / len(words) + self.weights[-1], -60, 60))))


def fit(voted: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray]:
    """The label model from all vote patterns, and the scorer from a sample of documents."""
    rows = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** labellers
    patterns = np.array([r["votes"] for r in rows], np.int8).reshape(len(rows), len(LABELLERS))
    model = LabelModel(patterns, np.array([r["n"] for r in rows], float))
    total = sum(r["n"] for r in rows)
    draw = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) < int(min(1, sample / max(1, total)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            found = [features(t) for t in raw(batch.column("text"))]
            yield {"places": pa.array([f[0] for f in found], pa.list_(pa.int32())),
                   "shares": pa.array([f[1] for f in found], pa.list_(pa.float64())), "votes": batch.column("votes")}

    drawn = map_arrow(voted.filter(draw & F.col("text").isNotNull()), run,
                      "places array<int>, shares array<double>, votes array<tinyint>")
    bounded: list[tuple[np.ndarray, np.ndarray, float]] = []
    for r in drawn.toLocalIterator():
        good = float(model.good(np.array([r["votes"]], np.int8))[0])
        bounded.append((np.array(r["places"], np.int32), np.array(r["shares"]), good))
    return model, train(bounded)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Votes, posterior of the label model, score of the trained model, and verdict of every document."""
    # Three passes read the votes; staged with their texts, the measures are taken once.
    voted = stage(votes(docs, doc_id, text), "votes")
    model, weights = fit(voted, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))
    kind = voted.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        labels, scorer = shared.value[0], Scorer(shared.value[1])
        for batch in pieces(batches, "text"):
            patterns = np.array(batch.column("votes").to_pylist(), np.int8).reshape(-1, len(LABELLERS))
            scores = [scorer.score(t) for t in raw(batch.column("text"))]
            yield {doc_id: batch.column("id"), "votes": pa.array([",".join(map(str, p)) for p in patterns], pa.string()),
                   "posterior": pa.array(labels.good(patterns)), "score": pa.array(scores, pa.float64()),
                   "kept": pa.array([s >= keep for s in scores], pa.bool_())}

    return map_arrow(voted, run, f"{doc_id} {kind}, votes string, posterior double, score double, kept boolean")
