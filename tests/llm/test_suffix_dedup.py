"""Removal of repeated passages, and the external suffix sorter below it, against brute force."""

import hashlib
import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest

from jobtrail.llm import induced_sort, suffix_dedup

SF = "/root/testdata/sf0.001"


def plain_suffixes(strings):
    """Sorted suffixes of all strings by direct comparison, a string's end below every symbol and by place."""
    text = [0]
    for s in strings:
        text += [x + 1 for x in s] + [0]
    ends = [i for i, x in enumerate(text) if not x]
    end_of = {i: e for b, e in zip(ends, ends[1:]) for i in range(b + 1, e)}
    order = sorted(end_of, key=lambda i: [(x, 0) for x in text[i:end_of[i]]] + [(0, end_of[i])])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while text[a + k] == text[b + k] != 0:
            k += 1
        common.append(min(k, induced_sort.CAP))
    return text, order, common


@pytest.mark.parametrize("limit", [1 << 22, 40, 5])
def test_induced_sort_against_plain_sort(monkeypatch, limit):
    """Small limits spill every queue and recurse down to a few names."""
    rng = random.Random(limit)
    for _ in range(80):
        monkeypatch.setattr(induced_sort, "BLOCK", rng.choice([7, 64, 1 << 20]))
        letters = rng.choice([1, 2, 3, 200])
        base = [rng.randrange(letters) for _ in range(rng.randrange(1, 150))]
        strings = []
        for _ in range(rng.randrange(1, 8)):
            s = list(base)
            for _ in range(rng.randrange(4)):
                s[rng.randrange(len(s))] = rng.randrange(4)
            strings.append(s[rng.randrange(len(s)):])
        text, order, common = plain_suffixes(strings)
        with tempfile.TemporaryDirectory() as folder:
            buckets = list(induced_sort.sorted_suffixes(np.array(text, np.int64), 1, folder, limit))[::-1]
        assert [i for places, _ in buckets for i in places.tolist()] == order
        assert [n for _, lengths in buckets for n in lengths.tolist()] == common


def plain_removal(docs):
    """Rows (id, text) in order of ids: what is left by a set of all strings seen so far."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(docs), key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.setdefault(b[i:i + 100], i)
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removal(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
            for r in suffix_dedup.remove_repeats(df).collect()}


def test_removal_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    expected = plain_removal([tuple(r) for r in docs.collect()])
    assert removal(docs) == expected
    assert sum(r[1] for r in expected.values()) > 10_000


def sentences(rng, n):
    return "".join(rng.choice("abcdefghij éß") for _ in range(n))


def corpus(rng):
    """Shared passages, a short line in a third of the texts, near copies, periodic texts, and copies."""
    shared = [sentences(rng, rng.randrange(90, 400)) for _ in range(6)]
    line, base = sentences(rng, 60), sentences(rng, 900)
    docs = []
    for k in range(240):
        parts = [sentences(rng, rng.randrange(0, 120))]
        if k % 3 == 0:
            parts += [line, sentences(rng, 80), line]
        if k % 4 == 1:
            parts += rng.choices(shared, k=2)
        if k % 7 == 2:
            at = rng.randrange(800)
            parts += [base[:at] + "X" + base[at:]]
        if k % 31 == 5:
            parts += [rng.choice(["a", "ab", "abc"]) * rng.randrange(20, 300)]
        docs.append((k, "".join(parts)))
    return docs + [(1000 + k, docs[0][1] * 3) for k in range(40)]


@pytest.mark.parametrize("small", [False, True])
def test_removal_in_many_batches_and_shards(spark, monkeypatch, small):
    docs = corpus(random.Random(9))
    if small:  # texts cut into pieces, many shards, frequent grams, spilled queues
        for name, value in {"BATCH": 700, "SHARD": 3000, "OFTEN": 3, "LIMIT": 50}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
        monkeypatch.setattr(suffix_dedup, "stage", lambda df, label: df)
    random.Random(1).shuffle(docs)
    assert removal(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == plain_removal(docs)


def test_sorted_units_are_settled_over_batches():
    """Any cut of the sorted rows into batches gives the same decisions."""
    rng, shift = random.Random(4), suffix_dedup._SHIFT
    rows = []
    for _ in range(120):
        span = rng.randrange(3) << shift | 1
        rows.append((rng.randrange(6), rng.randrange(3), rng.randrange(4), 0, span))
    rows = sorted(rows + [(100 + k, 0, k, 0, ~(k << shift | 7)) for k in range(5)])
    names = ("gram", "digest", "id", "key", "span")

    def settled(size):
        schema = pa.schema([(n, pa.int64()) for n in names])
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k:k + size]], schema=schema) for k in range(0, len(rows), size)]
        found = []
        for out in suffix_dedup._settle(iter(batches)):
            found += zip(*[out[n].tolist() for n in ("id", "key", "span")], pa.array(out["gram"]).to_pylist())
        return sorted(found, key=repr)

    held = {}
    for r in rows:
        if r[4] >= 0:
            held.setdefault(r[:2], []).append(r)
    expected = [(*r[2:], None) for r in rows if r[4] < 0]
    expected += [(r[2], r[3], ~r[4], None) for some in held.values() for r in some if r[2:] != some[0][2:]]
    grams = [u[0] for u in held]
    expected += [(*some[0][2:], u[0]) for u, some in held.items() if grams.count(u[0]) > 1]
    for size in (1, 2, 3, 7, 1000):
        assert settled(size) == sorted(expected, key=repr)


def test_shards_keep_a_gram_together(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 50)
    rng = random.Random(8)
    rows = [(g, b"x" * rng.randrange(1, 30)) for g in range(40) for _ in range(rng.choice([1, 2, 9]))]
    for size in (1, 3, 1000):
        batches = [pa.RecordBatch.from_pydict({"gram": [g for g, _ in rows[k:k + size]], "unit": [u for _, u in rows[k:k + size]]})
                   for k in range(0, len(rows), size)]
        shards = [[(g, u) for b in shard for g, u in zip(b["gram"].to_pylist(), b["unit"].to_pylist())]
                  for shard in suffix_dedup._cut_shards(iter(batches))]
        assert [r for shard in shards for r in shard] == rows and len(shards) > 8
        assert all(a[-1][0] != b[0][0] for a, b in zip(shards, shards[1:]))


def test_removal_edges(spark, edge, none):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.remove_repeats(edge).collect()}
    assert rows[1, 0]["kept_sha256"] == rows[2, 0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[4, 4]["n_removed"] == 0 and rows[None, 17]["n_removed"] == 0
    alone = plain_removal([(6, "lorem ipsum dolor sit amet " * 4000), (7, "x" * 50_000)])
    for k, n in ((6, 108_000), (7, 50_000)):
        assert tuple(rows[k, n])[1:] == alone[k]
    assert suffix_dedup.remove_repeats(edge).count() == edge.count()
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_rows_of_equal_id(spark):
    """Repeated rows are one document; other texts of the id are ordered among themselves; NULL comes last."""
    passage = "".join(chr(97 + k * k % 26) for k in range(300))
    docs = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, "q" + passage), (2, "r" + passage)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"] - r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got[0] == got[1] == ("1", plain_removal([(1, passage)])[1][0] - plain_removal([(1, passage)])[1][1])
    assert got[2:4] == [("2", 1), ("2", 1)] and got[4] == ("None", 0)
