"""Suffixes of a shard of strings in order, with common-prefix lengths, by external induced sorting.

The shard is one array of symbols in a file; symbols below ``first`` are separators, which differ
from each other, so no comparison goes past one. Every step works on one bucket of suffixes, those
with the same first symbol, and what waits for a later bucket stands in a :class:`Queue` on disk:

1. Places are classified from right to left: S if the suffix is smaller than the next one, L if it is
   larger, and star if an S follows an L.
2. Star substrings (from one star to the next) are sorted bucket by bucket and named by rank. The
   names in text order are a shorter string. If names repeat, its suffixes are sorted by the same
   procedure, recursively; a string that fits the limit is sorted by prefix doubling. That orders
   the star suffixes.
3. Ascending over the buckets, each suffix i, star or L, puts i - 1 into the queue of its symbol if
   that is of type L; descending, each suffix, L or S, does the same for type S. Queues give out what
   came first, so that every bucket is in order when its turn comes: a priority queue by (symbol, arrival).

A queue entry is the suffix and the length it has in common with the entry before it: one more than
the least common length between the two suffixes that put them there. That minimum is taken from a
table of range minima within a batch, and from one number a symbol between batches. Lengths stop
counting at ``CAP``. Star suffixes start with lengths compared in the text.

Memory: one bucket, the blocks of a scan, up to ``limit`` entries of each queue and array (what is longer is
in files), and one array that is never in a file: the order of the star suffixes, 8 bytes each and a byte for
their lengths, about a third of the places. The files are spills of one task, gone when it ends or fails.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Common lengths are counted up to here.
CAP = 100
#: Symbols in one block of a scan.
BLOCK = 1 << 20


class Spool:
    """An array that grows in memory, and beyond ``limit`` entries in a file that is read back as a map."""

    def __init__(self, folder: str, name: str, dtype, limit: int):
        self.path, self.dtype, self.limit, self.size = _fresh(folder, name), np.dtype(dtype), limit, 0
        self.parts: list[np.ndarray] = []
        self.stored = 0

    def append(self, values: np.ndarray) -> None:
        self.parts.append(np.ascontiguousarray(values, self.dtype))
        self.size += len(values)
        if self.size - self.stored > self.limit:
            self._store()

    def _store(self) -> None:
        with open(self.path, "ab") as out:
            for part in self.parts:
                part.tofile(out)
        self.parts, self.stored = [], self.size

    def array(self) -> np.ndarray:
        if self.stored:
            self._store()
            return np.memmap(self.path, self.dtype, "r", shape=(self.size,))
        self.parts = [np.concatenate(self.parts)] if self.parts else [np.empty(0, self.dtype)]
        return self.parts[0]


def room(folder: str, name: str, dtype, size: int, limit: int) -> np.ndarray:
    """Zeros to write to, in a file if they are more than ``limit``."""
    return np.memmap(_fresh(folder, name), dtype, "w+", shape=(size,)) if size > limit else np.zeros(size, dtype)


def _fresh(folder: str, name: str) -> str:
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")


class Queue:
    """Entries by symbol, first in first out; beyond ``limit`` entries all wait in files."""

    def __init__(self, folder: str, name: str, limit: int):
        self.prefix, self.limit, self.held = _fresh(folder, name), limit, 0
        self.waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        self.spilled: set[int] = set()

    def push(self, symbols: np.ndarray, entries: np.ndarray) -> None:
        """Entries whose symbols are grouped."""
        if not len(entries):
            return
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for symbol, part in zip(symbols[np.append(0, cuts)].tolist(), np.split(entries, cuts), strict=True):
            self.waiting[symbol].append(part)
        self.held += len(entries)
        if self.held > self.limit:
            for symbol, parts in self.waiting.items():
                with open(f"{self.prefix}-{symbol}", "ab") as out:
                    np.concatenate(parts).tofile(out)
                self.spilled.add(symbol)
            self.waiting.clear()
            self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        parts = self.waiting.pop(symbol, [])
        self.held -= sum(map(len, parts))
        if symbol in self.spilled:
            self.spilled.discard(symbol)
            path = f"{self.prefix}-{symbol}"
            parts = [np.fromfile(path, np.int64), *parts]
            os.remove(path)
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


def sorted_suffixes(text: np.ndarray, first: int, folder: str, limit: int,
                    common: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Suffixes that start with no separator, bucket by bucket in descending order of symbols.

    Inside a bucket they ascend; the second array has the length each has in common with the one
    before it, 0 for the first. ``text`` begins and ends with a separator.
    """
    stars, symbols, n_separators = _star_order(text, first, folder, limit)
    lengths = _star_common(text, first, stars) if common else None
    return _Induction(text, first, folder, limit, symbols, common).run(stars, lengths, n_separators)


def classify(text: np.ndarray, first: int, folder: str, limit: int) -> np.ndarray:
    """4 * symbol + 2 if the place is S + 1 if it is a star, for every place."""
    n = len(text)
    codes = room(folder, "codes", np.int64, n, limit)
    next_symbol, next_small, end = -1, True, n
    while end > 0:
        begin = max(0, end - BLOCK)
        here = np.asarray(text[begin:end], np.int64)
        follow = np.append(here[1:], next_symbol)
        # Where neighbours are equal the type is that of the next place, so that of the next difference.
        step = np.where(here < first, 1, np.sign(follow - here))
        known = np.where(step != 0, np.arange(len(here)), len(here))
        known = np.minimum.accumulate(known[::-1])[::-1]
        small = np.append(step, 1 if next_small else -1)[known] > 0
        codes[begin:end] = here * 4 + small * 2
        # Stars: S after L. The place before the block tells for its first one.
        after = small[1:] & ~small[:-1]
        codes[begin + 1:end] |= after
        if end < n and next_small and not small[-1]:
            codes[end] |= 1
        next_symbol, next_small, end = int(here[0]), bool(small[0]), begin
    # Separators are stars whatever stands before them.
    for begin in range(0, n, BLOCK):
        block = codes[begin:begin + BLOCK]
        block |= (block >> 2 < first).astype(np.int64)
    return codes


def regroup(key: np.ndarray, members: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members sorted by (group, key), the number of each one's new group, and the sizes of those groups.

    A group's number is the place of its first member.
    """
    order = np.lexsort((key, group))
    key, old, members = key[order], group[order], members[order]
    opens = np.ones(len(members), bool)
    opens[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
    firsts = np.flatnonzero(opens)
    sizes = np.diff(np.append(firsts, len(members)))
    base = np.flatnonzero(np.append(True, old[1:] != old[:-1])) if len(members) else firsts
    base = np.repeat(base, np.diff(np.append(base, len(members))))
    return members, old + np.repeat(firsts, sizes) - base, np.repeat(sizes, sizes)


def _star_order(text: np.ndarray, first: int, folder: str, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Stars in the order of their suffixes, separators first and by place; all other symbols; the number of separators."""
    codes = classify(text, first, folder, limit)
    n = len(text)
    waiting, separators, symbols = Queue(folder, "stars", limit), Spool(folder, "separators", np.int64, limit), np.empty(0, np.int64)
    for begin in range(0, n, BLOCK):
        block = codes[begin:begin + BLOCK]
        at = np.flatnonzero(block & 1)
        symbol = block[at] >> 2
        ends = symbol < first
        separators.append(begin + at[ends])
        at, symbol = at[~ends], symbol[~ends]
        order = np.argsort(symbol, kind="stable")
        waiting.push(symbol[order], begin + at[order])
        symbols = np.union1d(symbols, block >> 2)
    symbols = symbols[symbols >= first]
    names = room(folder, "names", np.int64, n, limit)
    names[separators.array()] = np.arange(separators.size)
    unique, name, order = True, separators.size, Spool(folder, "order", np.int64, limit)
    order.append(separators.array())
    for symbol in symbols.tolist():
        stars = waiting.pop(symbol)
        if len(stars):
            stars, rank = _by_substring(stars, codes)
            fresh = np.append(True, rank[1:] != rank[:-1])
            names[stars] = name + np.cumsum(fresh) - 1
            name += int(fresh.sum())
            unique = unique and bool(fresh.all())
            order.append(stars)
    if unique:
        return order.array(), symbols, separators.size
    short, places = Spool(folder, "short", np.int64, limit), Spool(folder, "places", np.int64, limit)
    for begin in range(0, n, BLOCK):
        at = begin + np.flatnonzero(codes[begin:begin + BLOCK] & 1)
        places.append(at)
        short.append(names[at])
    ranks = _order_of(short.array(), separators.size, folder, limit)
    return places.array()[ranks], symbols, separators.size


def _by_substring(stars: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of one symbol, sorted by symbols and types up to the next star, and their ranks."""
    last = len(codes) - 1
    bits = max(1, int(codes.max()).bit_length())  # of 2 * symbol + type, plus one
    fit = max(1, 62 // bits)
    rank = np.zeros(len(stars), np.int64)
    result = np.empty(len(stars), np.int64)
    active, at, total = np.arange(len(stars)), 1, rank
    done = np.zeros(len(stars), bool)
    while len(active):
        key = np.zeros(len(active), np.int64)
        over = done[active]
        for k in range(at, at + fit):
            code = codes[np.minimum(stars[active] + k, last)]
            key = key << bits | np.where(over, 0, (code >> 1) + 1)
            over = over | (code & 1).astype(bool)
        done[active] = over
        members, groups, sizes = regroup(key, active, total[active])
        total[members] = groups
        # Equal stars end together; those of one that have ended are one name.
        active = members[(sizes > 1) & ~done[members]]
        at += fit
    order = np.argsort(total, kind="stable")
    result = stars[order]
    return result, total[order]


def _order_of(text: np.ndarray, first: int, folder: str, limit: int) -> np.ndarray:
    """All places of a string in suffix order."""
    if len(text) <= limit:
        return _doubling(np.asarray(text))
    out = Spool(folder, "suffixes", np.int64, limit)
    buckets = Spool(folder, "sizes", np.int64, limit)
    # A string of names needs separators at both ends, as the text has.
    for places, _ in sorted_suffixes(text, first, folder, limit, common=False):
        out.append(places)
        buckets.append(np.array([len(places)]))
    ends = np.cumsum(buckets.array())
    whole = out.array()
    ordered = [np.flatnonzero(np.asarray(text) < first)]
    ordered += [whole[e - size:e] for e, size in zip(ends[::-1].tolist(), buckets.array()[::-1].tolist(), strict=True)]
    # Separators of a short string are numbered by place already.
    return np.concatenate(ordered)


def _doubling(text: np.ndarray) -> np.ndarray:
    """Suffix order by ranks of ever longer prefixes; equal places drop out once they are told apart."""
    members, groups, sizes = regroup(text, np.arange(len(text)), np.zeros(len(text), np.int64))
    rank = np.empty(len(text), np.int64)
    rank[members] = groups
    active, h = members[sizes > 1], 1
    while len(active):
        members, groups, sizes = regroup(rank[active + h], active, rank[active])
        rank[members] = groups
        active = members[sizes > 1]
        h *= 2
    order = np.empty(len(text), np.int64)
    order[rank] = np.arange(len(text))
    return order


def _star_common(text: np.ndarray, first: int, stars: np.ndarray) -> np.ndarray:
    """Length each star suffix has in common with the one before it, up to CAP."""
    common = np.zeros(len(stars), np.uint8)
    for begin in range(0, len(stars), BLOCK):
        block = np.asarray(stars[max(0, begin - 1):begin + BLOCK])
        a, b = block[:-1], block[1:]
        length = np.zeros(len(a), np.uint8)
        alive = np.arange(len(a))
        for k in range(CAP):
            x = text[np.minimum(a[alive] + k, len(text) - 1)]
            alive = alive[(x == text[np.minimum(b[alive] + k, len(text) - 1)]) & (x >= first)]
            if not len(alive):
                break
            length[alive] += 1
        common[max(0, begin - 1) + 1:max(0, begin - 1) + 1 + len(length)] = length
    return common


class _Minima:
    """Least value between two places, from minima over powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows, k = [values], 1
        while 2 * k <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-k], last[k:]))
            k *= 2
        self.offsets = np.cumsum([0, *map(len, self.rows[:-1])])
        self.flat = np.concatenate(self.rows)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum from a to b, both included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        start = self.offsets[level]
        return np.minimum(self.flat[start + a], self.flat[start + b + 1 - (1 << level)])


class _Induction:
    """Both passes over the buckets of one string."""

    def __init__(self, text, first, folder, limit, symbols, common):
        self.text, self.first, self.folder, self.limit = text, first, folder, limit
        self.symbols, self.common = symbols, common
        self._fresh()

    def _fresh(self) -> None:
        self.queue = Queue(self.folder, "queue", self.limit)
        if self.common:
            size = int(self.symbols[-1]) + 1 if len(self.symbols) else 1
            self.seen, self.since = np.zeros(size, bool), np.full(size, CAP, np.uint8)

    def run(self, stars, lengths, n_separators):
        text = self.text
        larger = Queue(self.folder, "larger", self.limit)
        self._pass_on(np.asarray(stars[:n_separators]), np.zeros(n_separators, np.uint8), np.greater_equal)
        at = n_separators
        for symbol in self.symbols.tolist():
            last = None
            while len(entries := self.queue.pop(symbol)):
                larger.push(np.full(len(entries), symbol), entries)
                self._pass_on(entries >> 8, (entries & 255).astype(np.uint8), np.greater_equal)
                last = int(entries[-1] >> 8)
            end = at
            while end < len(stars):
                other = np.flatnonzero(text[stars[end:end + BLOCK]] != symbol)
                end += int(other[0]) if len(other) else min(BLOCK, len(stars) - end)
                if len(other):
                    break
            if end > at:
                some = np.asarray(stars[at:end])
                here = np.asarray(lengths[at:end]).copy() if self.common else None
                if self.common:
                    here[0] = 0 if last is None else self._run_in_common(last, int(some[0]), symbol)
                self._pass_on(some, here, np.greater)
                at = end
        self._fresh()
        for symbol in self.symbols[::-1].tolist():
            parts, last = [], None
            while len(entries := self.queue.pop(symbol)):
                parts.append(entries)
                self._pass_on(entries >> 8, (entries & 255).astype(np.uint8), np.less_equal)
                last = int(entries[-1] >> 8)
            small = np.concatenate(parts) if parts else np.empty(0, np.int64)
            large = larger.pop(symbol)
            border = 0
            if len(large):
                if self.common and last is not None:
                    border = self._run_in_common(int(large[-1] >> 8), last, symbol)
                downward = np.append((large[1:] & 255).astype(np.uint8), np.uint8(0))
                self._pass_on(large[::-1] >> 8, np.append(np.uint8(border), downward[::-1][1:]), np.less)
            places = np.concatenate([large, small[::-1]]) >> 8
            if not self.common:
                yield places, None
                continue
            # Entries of the second pass know the larger neighbour; turned round, it is the smaller one.
            upward = np.append((small[1:] & 255)[::-1], 0)
            upward = np.append(border, upward[:-1]) if len(small) else upward[:0]
            yield places, np.concatenate([large & 255, upward]).astype(np.uint8)

    def _run_in_common(self, a: int, b: int, symbol: int) -> int:
        """Common length of an L and an S suffix of one bucket: the shorter run of its symbol."""
        k = 0
        while k < CAP and self.text[a + k] == symbol == self.text[b + k]:
            k += 1
        return k

    def _pass_on(self, places: np.ndarray, lengths: np.ndarray | None, wanted) -> None:
        """Put the places before these into their queues, if their type is the one of this pass."""
        if not len(places):
            return
        before = np.asarray(self.text[np.maximum(places - 1, 0)], np.int64)
        own = np.asarray(self.text[places], np.int64)
        keep = np.flatnonzero(wanted(before, own) & (before >= self.first) & (places > 0))
        symbols = before[keep]
        order = np.argsort(symbols, kind="stable")
        keep, symbols = keep[order], symbols[order]
        if not self.common:
            self.queue.push(symbols, places[keep] - 1 << 8)
            return
        lowest = np.minimum.accumulate(lengths)
        opens = np.append(True, symbols[1:] != symbols[:-1]) if len(keep) else np.empty(0, bool)
        value = np.empty(len(keep), np.int64)
        firsts, rest = np.flatnonzero(opens), np.flatnonzero(~opens)
        if len(rest):
            value[rest] = _Minima(lengths).between(keep[rest - 1] + 1, keep[rest]).astype(np.int64) + 1
        groups = symbols[firsts]
        value[firsts] = np.where(self.seen[groups], np.minimum(self.since[groups], lowest[keep[firsts]]).astype(np.int64) + 1, 0)
        self.since = np.minimum(self.since, lowest[-1])
        if len(keep):
            highest = np.append(np.minimum.accumulate(lengths[::-1])[::-1], np.uint8(CAP))
            self.since[groups] = highest[keep[np.append(firsts[1:], len(keep)) - 1] + 1]
            self.seen[groups] = True
        self.queue.push(symbols, (places[keep] - 1 << 8) + np.minimum(value, CAP))
