"""Periodic runs and the filter audit, against brute force and on the edge rows."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from jobtrail.llm import filter_audit, periodic_runs
from jobtrail.llm.oracles import FILTER_AUDIT

SF = "/root/testdata/sf0.001"


# periodic runs


def plain_runs(w):
    """Every stretch of every period, by comparing words q apart; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(24, 3 * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_texts(rng, n):
    for _ in range(n):
        letters = rng.choice([1, 2, 3, 5, 50])
        w = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(160))]
        if len(w) > 30 and rng.random() < 0.7:
            p, a = rng.randrange(1, 14), rng.randrange(len(w))
            w = w[:a] + (w[a:a + p] * 100)[:rng.randrange(20, 90)] + w[a:]
        yield w + [b"x"] + w if rng.random() < 0.3 else w


def test_runs_against_all_periods():
    texts = list(random_texts(random.Random(1), 1500))
    for at in range(0, len(texts), 30):
        some = texts[at:at + 30]
        assert periodic_runs.runs_of(some) == [plain_runs(w) for w in some]


def test_runs_of_long_texts():
    rng = random.Random(2)
    ones = [b"a"] * 50_000
    passages = [w for k in range(3000) for w in [b"%d" % rng.randrange(10**6)] + [b"w%d" % i for i in range(20)]]
    cycle = [b"%d" % i for i in range(500)] * 100
    assert periodic_runs.runs_of([ones, passages, cycle, []]) == [[(0, 50_000, 1)], [], [(0, 50_000, 500)], []]


def test_runs_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(docs, planted=True).collect()}
    planted = 0
    for row in docs.select("doc_id", "text").collect():
        w, h = (row["text"] or "").encode().split(), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        runs, got = plain_runs(w), found[row["doc_id"]]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert got["n_runs"] == len(runs)
        assert (got["start"], got["length"], got["period"]) == (best or (None, None, None))
        assert got["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(
            b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
    assert planted > 5 and len(found) == docs.count()


def test_runs_edges(spark, edge, none):
    rows = {(r["doc_id"], r["n_runs"], r["length"], r["period"]) for r in periodic_runs.find_runs(edge).collect()}
    assert rows == {(k, 0, None, None) for k in (1, 2, 3, 4, 5, 7, None)} | {(6, 1, 20_000, 5)}
    assert periodic_runs.find_runs(edge, planted=True).count() == edge.count()
    assert periodic_runs.find_runs(none).count() == 0
    nothing = periodic_runs.find_runs(edge.filter("doc_id = 2")).first()
    assert nothing["runs_sha256"] == nothing["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


# filter audit


def plain_audit(docs, labels):
    """Every order and step, document by document."""
    smallest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(smallest.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = {(s or "", o, k): Counter() for _, _, s in docs for o in map("".join, permutations("ABCDE")) for k in range(5)}
    for doc_id, text, source in docs:
        text = text or ""
        w = [x for x in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            any(c in "#$%&*|" for c in text), doc_id is not None and smallest[text] < doc_id), strict=True) if bad}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, f in enumerate(order):
                row = rows[source or "", order, k]
                row["unique_fails"] += fails == {f}
                row["redundant"] += f in fails and gone
                if f in fails and not gone:
                    gone = True
                    row["removed"] += 1
                    row["good_lost"] += doc_id in good
                    row["toxic_lost"] += doc_id in toxic
                row["kept"] += not gone
    shapley = Counter()
    for (part, order, k), row in rows.items():
        shapley[part, order[k]] += row["removed"]
    return {(part, order, k + 1): tuple(row[f] for f in filter_audit.FIELDS) + (shapley[part, order[k]],)
            for (part, order, k), row in rows.items()}


def audited(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in filter_audit.FIELDS) + (r["shapley"],) for r in rows}


def test_audit_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert audited(docs, labels) == plain_audit(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_audit_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (1, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    labels = labels.withColumn("source", F.lit("clash"))
    again = edge.unionByName(edge.withColumn("doc_id", F.col("doc_id") + 100))
    rows = [tuple(r) for r in again.select("doc_id", "text", "source").collect()]
    assert audited(again, labels) == plain_audit(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert filter_audit.audit(none, labels).count() == 0
    assert len(audited(edge, labels.limit(0))) == 600 * 3


def test_audit_with_many_parts_and_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 3)
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 23).alias("source"),
        F.when(F.col("id") % 3 == 0, "Same # text").otherwise(F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 250)).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("toxic"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert audited(docs, labels) == plain_audit(rows, [tuple(r) for r in labels.collect()])


def test_fields_never_run_over():
    top = 2**63 - 1
    total = top * filter_audit.outcome(31, True, True)
    fields = filter_audit.unpack(total)
    assert set(fields.ravel().tolist()) == {0, top}
    assert (fields[:, 0, 1] == top).all() and (fields[:, 1:, 2] == top).all()


@pytest.mark.parametrize("edge_rows", [False, True])
def test_audit_sql_twin(spark, edge, tmp_path, edge_rows):
    """The SQL of the query gives the brute-force rows too."""
    con = duckdb.connect()
    if edge_rows:
        rows = [tuple(r) for r in edge.select("doc_id", "text", "source").collect()]
        labels = [(4, 1, 0), (6, 0, 1)]
        con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
        con.execute("create table labels(doc_id bigint, quality int, toxic int)")
        con.executemany("insert into documents values (?, ?, ?)", rows)
        con.executemany("insert into labels values (?, ?, ?)", labels)
    else:
        for t in ("documents", "labels"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        rows = con.execute("select doc_id, text, source from documents").fetchall()
        labels = con.execute("select doc_id, quality, toxic from labels").fetchall()
    got = con.execute(f"select part, filter_order, step, {', '.join(filter_audit.FIELDS)}, shapley from ({FILTER_AUDIT})").fetchall()
    assert {r[:3]: r[3:] for r in got} == plain_audit(rows, labels)
