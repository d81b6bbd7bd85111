"""Periodic runs of words in whole texts: passages that repeat themselves three times or more.

A run is a stretch of consecutive words with smallest period q, at least ``max(24, 3 q)`` words
long, that neither neighbouring word extends.

Method: maximal pairs from the LCP-interval tree. Two places i < j of a text form a maximal pair of
length L if the L words from i equal those from j and neither the words before nor those after
agree. A stretch with period q that nothing extends *is* such a pair of distance q, with
L = length - q, and every maximal pair with ``L >= 2 q`` and ``L + q >= 24`` is such a stretch; so runs
are read off pairs and nothing is extended. Pairs whose distance is a multiple of the smallest
period give the same stretch again (by Fine and Wilf the smallest period divides the distance), and
the smallest distance of a stretch is kept.

The tree is walked bottom up over the sorted suffixes. A node holds the places below it in order,
and class lists: the places by the word on their left. When a child joins its parent, whose words in
common are L, the smaller side asks for every place the partners on the other side at most L / 2 away;
those in its own class are no maximal pair. The number of partners in the window, less those of
its own class, says how many there are. They stand at the far end of the window on the left, and on
the right are all of the window or none: occurrences of the same L words that lie this close are
evenly spaced, so all but the first have the same word before them. Each question is a few binary searches.

A useful pair has L >= 16 (24 - q and 2 q are both smaller only beyond that), so only nodes with 16
common words or more are built: places are ranked by their first 1, 2, 4, 8 and 16 words by
doubling, a whole batch of texts in one array, and a place whose words are unique in its text drops
out at once. What is left is sorted to the end by further doubling. Memory follows the words of a
batch, about 4 MB of text, or of one longer text.

Defined cases: a NULL text has no words; a NULL id is never planted; repeated rows give repeated
results; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.texts import map_arrow, pieces, raw

#: Shortest run in words, and the least number of periods in it.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Fewest common words of a pair that can be a run: min over q of max(24 - q, 2 q).
LEAST_COMMON = 16
#: Bytes of text in one array.
BATCH = 4 << 20

Run = tuple[int, int, int]


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text in which one document in ten repeats its tail."""
    n = len(words)
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * -(-(n - a) // p))[:n - a]


def suffix_order(texts: Sequence[list[bytes]]) -> tuple[np.ndarray, list[int], list[int]]:
    """Places of all texts whose first LEAST_COMMON words occur twice in their text, in suffix order.

    Returns the places, the words of all texts as numbers in one list, each text followed by a
    number of its own, and the start of each text in it.
    """
    code: dict[bytes, int] = {}
    numbers, starts = [], []
    for text in texts:
        starts.append(len(numbers))
        numbers.extend([code.setdefault(w, len(code)) for w in text])
        numbers.append(-1)
    flat = np.array(numbers, np.int64)
    total = len(flat)
    ends = flat < 0
    # Words of different texts differ, so that no group crosses texts; ends are all different.
    flat[ends] = len(code)
    text_no = np.cumsum(ends) - ends
    rank, active = _regroup(text_no * (len(code) + 1) + flat, np.arange(total), np.zeros(total, np.int64), np.zeros(total, np.int64))
    h = 1
    while h < LEAST_COMMON and len(active):
        rank, active = _double(rank, active, h)
        h *= 2
    places = active
    while len(active):
        rank, active = _double(rank, active, h)
        h *= 2
    flat[ends] = -1
    return places[np.argsort(rank[places])], flat.tolist(), starts


def _double(rank: np.ndarray, active: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    return _regroup(rank[active + h], active, rank[active], rank)


def _regroup(key: np.ndarray, active: np.ndarray, group: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split the groups of the active places by ``key``; a rank is the first number of its group."""
    order = np.lexsort((key, group))
    key, group, active = key[order], group[order], active[order]
    opens = np.ones(len(active), bool)
    opens[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(opens)
    sizes = np.diff(np.append(first, len(active)))
    # Place in its old group of the first of the new group.
    old = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(active) else first
    base = np.repeat(old, np.diff(np.append(old, len(active))))
    rank = rank.copy() if len(rank) == len(active) else rank
    rank[active] = group + np.repeat(first, sizes) - base
    return rank, active[np.repeat(sizes > 1, sizes)]


def common_words(places: np.ndarray, words: list[int]) -> list[int]:
    """Words that each place has in common with the place before it in suffix order, in text order
    by the rule that the next place has at most one word less (while both stay among the places)."""
    order = places.tolist()
    before = dict(zip(order[1:], order[:-1], strict=True))
    common = {}
    last, length = -2, 0
    for i in sorted(order):
        length = length - 1 if i == last + 1 and length > LEAST_COMMON else 0
        last = i
        if (j := before.get(i)) is None:
            common[i] = length = 0
            continue
        while words[i + length] == words[j + length] >= 0:
            length += 1
        common[i] = length
    return [common[i] for i in order]


class Node:
    """Places below a node of the tree, in order, and by the word on their left."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}

    def join(self, other: Node) -> Node:
        """The union; the larger side takes in the smaller one."""
        large, small = (self, other) if len(self.places) >= len(other.places) else (other, self)
        _insert(large.places, small.places)
        for left, places in small.classes.items():
            if left in large.classes:
                _insert(large.classes[left], places)
            else:
                large.classes[left] = places
        return large


def _insert(into: list[int], places: list[int]) -> None:
    if len(places) * 16 < len(into):
        for i in places:
            insort(into, i)
    else:
        into.extend(places)
        into.sort()  # two ascending runs: a merge


def _pairs(one: Node, two: Node, length: int, words: list[int], found: dict) -> None:
    """Maximal pairs between two children of a node with ``length`` words in common."""
    small, large = (one, two) if len(one.places) <= len(two.places) else (two, one)
    reach = length // 2
    nearest = max(1, LEAST_WORDS - length)
    for left, members in small.classes.items():
        own = large.classes.get(left, ())
        for i in members:
            # Left of i: partners of another class, from the far end.
            at, end = bisect_left(large.places, i - reach), bisect_left(large.places, i)
            others = end - at - (bisect_left(own, i) - bisect_left(own, i - reach))
            while others:
                j = large.places[at]
                at += 1
                if (words[j - 1] if j else -1) != left:
                    others -= 1
                    _keep(found, j, i, length, nearest)
            at, end = bisect_right(large.places, i), bisect_right(large.places, i + reach)
            others = end - at - (bisect_right(own, i + reach) - bisect_right(own, i))
            while others:
                j = large.places[at]
                at += 1
                if words[j - 1] != left:
                    others -= 1
                    _keep(found, i, j, length, nearest)


def _keep(found: dict, i: int, j: int, length: int, nearest: int) -> None:
    if (q := j - i) >= nearest:
        stretch = (i, length + q)
        found[stretch] = min(q, found.get(stretch, q))


def runs_of(texts: Sequence[list[bytes]]) -> list[list[Run]]:
    """Runs (start, length, period) of each text, by start and period."""
    places, words, starts = suffix_order(texts)
    result: list[list[Run]] = [[] for _ in texts]
    if not len(places):
        return result
    order = places.tolist()
    common = common_words(places, words)
    found: dict[tuple[int, int], int] = {}
    open_nodes: list[tuple[int, Node]] = []
    for k, place in enumerate(order):
        node = Node(place, words[place - 1] if place else -1)
        up_to = common[k + 1] if k + 1 < len(order) else 0
        while open_nodes and open_nodes[-1][0] >= up_to:
            length, parent = open_nodes.pop()
            _pairs(parent, node, length, words, found)
            node = parent.join(node)
        if up_to >= LEAST_COMMON:
            open_nodes.append((up_to, node))
        else:
            open_nodes.clear()
    at = np.searchsorted(starts, [i for i, _ in found], side="right") - 1
    for (i, length), k in zip(sorted(found), np.sort(at).tolist(), strict=True):
        result[k].append((i - starts[k], length, found[i, length]))
    for runs in result:
        runs.sort(key=lambda r: (r[0], r[2]))
    return result


def report(words: list[bytes], runs: list[Run]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text."""
    best = None
    for run in runs:
        # Greater length / period, exactly; the order of the runs settles ties.
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = words
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            dropped[s + q] += 1
            dropped[s + n] -= 1
        kept = [w for w, d in zip(words, np.cumsum(dropped)[:-1].tolist(), strict=True) if not d]
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def find_runs(documents: DataFrame, planted: bool = False) -> DataFrame:
    """Number of runs, the one with most periods, and digests of all runs and of the collapsed text.

    ``planted`` first makes one document in ten repeat its tail (see :func:`plant`). A collapsed text
    keeps the first period of every run.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "_text", BATCH):
            ids = batch.column("_id").to_pylist()
            texts = [(text or b"").split() for text in raw(batch.column("_text"))]
            if planted:
                texts = [plant(text, doc_id) for text, doc_id in zip(texts, ids, strict=True)]
            rows = [report(text, runs) for text, runs in zip(texts, runs_of(texts), strict=True)]
            columns = list(zip(*rows, strict=True))
            yield {"doc_id": batch.column("_id"),
                   **{name: pa.array(columns[k], pa.int64())
                      for k, name in enumerate(("n_runs", "start", "length", "period", "exponent_milli"))},
                   "runs_sha256": pa.array(columns[5], pa.string()), "collapsed_sha256": pa.array(columns[6], pa.string())}

    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")), read, SCHEMA)
