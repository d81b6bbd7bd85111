"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets form
a class and only one of them goes on. Every class carries ``COORDINATES`` minwise tokens of its
set. Each of ``TREES`` trees puts it in the node of its first minwise token. In a node

* one whose classes are one component is finished;
* one of at most ``LEAF`` classes is compared exhaustively;
* in a larger one every class is compared with the node's first, so that a large group of near copies
  becomes one component after as many comparisons as it has members; if that does not finish it,
  it is branched: a child is named by ``STEP`` other minwise tokens, chosen by the node, and each
  class goes to ``BRANCH`` children. What is still large after ``DEPTH`` levels is compared exhaustively
  in blocks, which no task holds whole.

A comparison first looks at odd sketches, ``BITS`` parities of hashed members: the parities in which two
sets differ never outnumber their symmetric difference, so no link is lost (of sets above ``WHOLE``
members a part is sketched, and a link passes but for six standard deviations). Of a leaf's candidates only
those go on that hold its groups together, and a second round takes all that still lie between
components. Every pair is confirmed on the full sets.

The threshold ``similarity`` is in percent. A pair at 85 meets in one tree with a probability of 0.85, or 0.83 after a
branching and at least 0.77 after four, so eight trees miss at most about one pair in 100,000; a group only falls apart if
all pairs that hold it together are missed. Lower thresholds take more trees for the same bound (``trees_for``).

Defined cases: NULL, empty and wordless texts have an empty set, ``component_id`` = ``doc_id`` and are
kept; fewer words than a shingle are one shingle; rows that repeat a ``doc_id`` are the same document,
linked if any of its texts is; a NULL ``doc_id`` takes the component of its class, or NULL, and names none; an empty
table gives an empty result. Further columns of the input are not touched and may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.texts import columns, map_arrow, pieces, raw
from jobtrail.session import stage

WORDS = 5
SIMILARITY = 85
TREES = 8
COORDINATES = 32
BITS = 1024
WHOLE = 2048
LEAF = 4096
STEP = 3
BRANCH = 4
DEPTH = 4
SALTS = 16

_random = np.random.default_rng(7)
_ODD = _random.integers(1, 1 << 63, WORDS * 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORD = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=1)], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = len(parts) - words + 1
    total = hashed[:size] * _ODD[0]
    for k in range(1, words):
        total = total + hashed[k:k + size] * _ODD[k]
    return np.unique(_mixed(total))


def minwise(values: np.ndarray) -> np.ndarray:
    """One token for each coordinate: the smallest value under that coordinate's hash."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 4096):
        part = values[start:start + 4096]
        np.minimum(least, (part[None, :] * _COORD[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def odd_sketch(values: np.ndarray) -> bytes:
    """Parities of the members in each of ``BITS`` places; of a large set, of one member in 2 ** k."""
    if len(values) > WHOLE:
        values = values[(values & np.uint64(_thinned(len(values)) - 1)) == 0]
    counts = np.bincount((values >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _thinned(size: int) -> int:
    return 1 << max(0, (max(size, 1) - 1) // WHOLE).bit_length()


def trees_for(similarity: int) -> int:
    """Trees that miss a pair at the threshold with the probability that ``TREES`` have at ``SIMILARITY``."""

    def missed(share: float) -> float:
        child = 1 - (1 - share ** STEP) ** BRANCH
        return 1 - share * child ** DEPTH

    if similarity >= SIMILARITY:
        return TREES
    count = math.ceil(TREES * math.log(missed(SIMILARITY / 100)) / math.log(missed(similarity / 100)))
    if count > COORDINATES:
        raise ValueError(f"a similarity of {similarity} takes {count} trees, more than {COORDINATES} coordinates")
    return count


def may_link(n_a: np.ndarray, n_b: np.ndarray, odd: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Whether sets of these sizes, whose sketches differ in ``odd`` places, can be similar enough."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    fits = similarity * large <= 100 * small
    most = (100 - similarity) * (n_a + n_b) / (100 + similarity)  # members in one set only
    rate = np.exp2(np.ceil(np.log2(np.maximum(1.0, (small - 1) // WHOLE + 1))))
    other = np.exp2(np.ceil(np.log2(np.maximum(1.0, (large - 1) // WHOLE + 1))))
    part = most / np.minimum(rate, other)
    likely = BITS / 2 * (1 - np.exp(-2 * part / BITS)) + 6 * np.sqrt(np.minimum(part, BITS / 4)) + 1
    limit = np.where(large <= WHOLE, most, likely)
    # Sketches of differently thinned sets say nothing.
    return fits & ((rate != other) | (odd <= limit))


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: size and digest of its set, its minwise tokens and its odd sketch."""
    rows = columns(docs, id=doc_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            sizes, keys, tokens, sketches = [], [], [], []
            for body in raw(batch.column("text")):
                values = shingles(body, words)
                sizes.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                tokens.append(minwise(values) if len(values) else None)
                sketches.append(odd_sketch(values) if len(values) else None)
            yield {"id": batch.column("id"), "n": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.binary()),
                   "tokens": pa.array(tokens, pa.list_(pa.int32())), "sketch": pa.array(sketches, pa.binary())}

    return map_arrow(rows, run, f"id {kind}, n long, key binary, tokens array<int>, sketch binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("set").alias("_a")), "a")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("_a"), batch.column("_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= similarity * (len(x) + len(y) - same))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield {"a": kept.column("a"), "b": kept.column("b")}

    return map_arrow(both.select("a", "b", "_a", "_b"), run, "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """Full sets of the wanted ids."""
    rows = columns(docs, id=doc_id, text=text).select(F.col("id").cast("long"), "text").join(wanted, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            values = [shingles(body, words) for body in raw(batch.column("text"))]
            yield {"id": batch.column("id"), "set": pa.array([v.tobytes() for v in values], pa.binary())}

    return map_arrow(rows, run, "id long, set binary").filter(F.length("set") > 0)


def components(links: DataFrame) -> DataFrame:
    """(id, label) with the smallest reachable id, for every id that has a link.

    Labels travel along links and then jump to the label of their label, so the number of
    rounds grows with the logarithm of the longest path, not with the path.
    """
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("label").alias("_heard"))
        told = labels.join(heard, "id").select("id", F.col("label").alias("_old"), F.least("label", "_heard").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("_next"))
        # A component's label repeats as often as it has members; the ids that name one are few.
        step = told.join(jump, "label", "left").select(
            "id", "_old", F.least("label", F.coalesce("_next", "label")).alias("label"))
        step = stage(step, "labels")
        labels = step.select("id", "label")
        if step.filter("_old <> label").isEmpty():
            return labels


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _open_nodes(members: DataFrame) -> DataFrame:
    """Members of the nodes that hold more than one component, with the node's size and first id."""
    nodes = members.groupBy("node").agg(
        F.count("*").alias("size"), F.min("id").alias("first"), F.min("label").alias("_l"), F.max("label").alias("_m"),
    ).filter("_l <> _m").drop("_l", "_m")
    return members.join(nodes, "node")


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def _sketched(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose sketches allow a link."""
    side = classes.select("id", "n", "sketch")
    both = (
        pairs.distinct()
        .join(side.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("sketch").alias("_a")), "a")
        .join(side.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("sketch").alias("_b")), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            odd = np.bitwise_count(_bits(batch.column("_a")) ^ _bits(batch.column("_b"))).sum(1)
            kept = batch.filter(pa.array(may_link(
                batch.column("_na").to_numpy(), batch.column("_nb").to_numpy(), odd, similarity)))
            yield {"a": kept.column("a"), "b": kept.column("b")}

    return map_arrow(both.select("a", "b", "_na", "_nb", "_a", "_b"), run, "a long, b long").distinct()


def candidates(ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, bits: np.ndarray, every: bool,
               similarity: int = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of different components that may link: ``every`` one, or those of a spanning forest."""
    count = len(ids)
    near = np.zeros((count, count), bool)
    for i in range(count - 1):  # a row at a time keeps the memory of a leaf small
        odd = np.bitwise_count(bits[i + 1:] ^ bits[i]).sum(1)
        near[i, i + 1:] = may_link(sizes[i + 1:], sizes[i], odd, similarity) & (labels[i + 1:] != labels[i]) & (ids[i + 1:] != ids[i])
    if every:
        return [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near))]
    found = []
    fresh = np.ones(count, bool)
    near |= near.T
    for root in range(count):
        if not fresh[root]:
            continue
        fresh[root] = False
        line = [root]
        while line:
            i = line.pop()
            reached = np.flatnonzero(near[i] & fresh)
            fresh[reached] = False
            found += [(int(ids[i]), int(ids[j])) for j in reached]
            line += reached.tolist()
    return found


def _exhaustive(members: DataFrame, every: bool, similarity: int) -> DataFrame:
    """Candidate pairs inside groups of bounded size."""
    rows = members.repartition("group").sortWithinPartitions("group")

    def pairs_of(table: pa.Table) -> dict:
        found: list[tuple[int, int]] = []
        if table.num_rows:
            groups, ids, sizes, labels = (table.column(c).to_numpy() for c in ("group", "id", "n", "label"))
            bits = _bits(table.column("sketch"))
            bounds = [0, *(np.nonzero(np.diff(groups))[0] + 1).tolist(), len(groups)]
            for start, stop in zip(bounds, bounds[1:]):
                if stop - start > 1:
                    at = slice(start, stop)
                    found += candidates(ids[at], sizes[at], labels[at], bits[at], every, similarity)
        found = list(set((min(p), max(p)) for p in found))
        return {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = None  # rows of a group that the next batch may go on with; bounded by the group's size
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            groups = table.column("group").to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))
            held = table.slice(cut)
            yield pairs_of(table.slice(0, cut))
        if held is not None:
            yield pairs_of(held)

    return map_arrow(rows.select("group", "id", "n", "label", "sketch"), run, "a long, b long").distinct()


def _blocks(members: DataFrame, leaf: int) -> DataFrame:
    """Large nodes as pairs of blocks: every two members meet in one group of two blocks."""
    blocks = F.ceil(F.col("size") * 2 / leaf).cast("int")
    own = F.pmod(F.xxhash64("id", "node"), blocks).cast("int")
    rows = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("group", F.xxhash64("node", F.least("_own", "_other"), F.greatest("_own", "_other")))


def _children(members: DataFrame) -> DataFrame:
    """Each member in its children: a child is named by the values of ``STEP`` coordinates."""
    rows = members.withColumn("_child", F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1))))
    values = [F.get("tokens", F.pmod(F.xxhash64("node", "_child", F.lit(k)), F.lit(COORDINATES)).cast("int")) for k in range(STEP)]
    return rows.select("id", F.xxhash64("node", "_child", *values).alias("node")).distinct()


def links_of(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text",
             words: int = WORDS, trees: int | None = None, leaf: int = LEAF, depth: int = DEPTH,
             similarity: int = SIMILARITY) -> tuple[DataFrame | None, DataFrame | None]:
    """Confirmed links between classes and the components they make (None without any link)."""
    trees = trees_for(similarity) if trees is None else trees
    roots = classes.select("id", F.posexplode(F.slice("tokens", 1, trees)).alias("_tree", "_token"))
    frontier = roots.select("id", F.xxhash64("_tree", "_token").alias("node")).distinct()
    links = labels = tried = None

    def add(pairs: DataFrame) -> bool:
        """Confirm staged pairs; whether there were any."""
        nonlocal links, labels, tried
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        if pairs.isEmpty():
            return False
        tried = pairs if tried is None else tried.union(pairs)
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        found = stage(_confirmed(pairs, stage(_sets(docs, wanted, doc_id, text, words), "sets"), similarity), "links")
        links = found if links is None else links.union(found)
        labels = components(links)
        return True

    leaves: list[DataFrame] = []
    for level in range(depth + 1):
        members = stage(_open_nodes(_labelled(frontier, labels)).drop("label"), "members")
        leaves.append(members.filter(F.col("size") <= leaf).select(F.col("node").alias("group"), "id"))
        large = members.filter(F.col("size") > leaf)
        if large.isEmpty():
            break
        if level == 0:
            star = large.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
            if add(_sketched(star, classes, similarity)):
                large = _open_nodes(_labelled(large.select("id", "node"), labels))
        if level == depth:
            leaves.append(_blocks(large, leaf).select("group", "id"))
            break
        frontier = stage(_children(large.select("id", "node").join(classes.select("id", "tokens"), "id")), "frontier")
    groups = leaves[0]
    for part in leaves[1:]:
        groups = groups.union(part)
    for every in (False, True):
        # Only groups that still hold several components are looked at again.
        still = _open_nodes(_labelled(groups.withColumnRenamed("group", "node"), labels)).withColumnRenamed("node", "group")
        if not add(_exhaustive(still.join(classes.select("id", "n", "sketch"), "id"), every, similarity)):
            break
    return links, labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    trees: int | None = None, leaf: int = LEAF, depth: int = DEPTH, similarity: int = SIMILARITY) -> DataFrame:
    """Per row: size of its set, component, and whether it is the component's document."""
    rows = stage(facts(docs, doc_id, text, words), "facts")
    own = rows.select(F.col("id").cast("long").alias("id"), "n", "key", "tokens", "sketch")
    classes = stage(own.filter("n > 0 and id is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("n").alias("n"),
        F.any_value("tokens").alias("tokens"), F.any_value("sketch").alias("sketch")), "classes")
    _, labels = links_of(docs, classes, doc_id, text, words, trees, leaf, depth, similarity)
    named = _labelled(classes.select("key", "id", "copies"), labels)
    # Only rows whose component is not their own id need to learn it.
    told = named.filter("copies > 1 or label <> id").select(
        "key", "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    spread = own.drop("tokens", "sketch").withColumn("_salt", F.pmod(F.coalesce(F.xxhash64("id"), F.lit(0)), F.lit(SALTS)).cast("int"))
    # NULL keys meet nothing in the join, so they are spread over the parts as well.
    component = F.coalesce("label", "id")
    return spread.join(told, ["key", "_salt"], "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, in its columns; documents without an id all stay."""
    report = near_duplicates(docs, doc_id, text, **options)
    kept = stage(report.filter(F.col("kept") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_kept")), "kept")
    named = docs.join(kept, docs[doc_id] == kept["_kept"], "left_semi").dropDuplicates([doc_id])
    return named.unionByName(docs.filter(docs[doc_id].isNull()))
