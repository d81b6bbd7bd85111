import pathlib

import pytest
from pyspark.sql import functions as F

from jobtrail.session import scratch_path
from jobtrail.sources.buckets import BucketLedger

SCHEMA = "k string, v long, bucket string"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path, "data").rglob("*.parquet")}


def make(spark, n=2000, buckets=32):
    path = scratch_path(spark, "buckets")
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.lit("x").alias("bucket"))
    return BucketLedger.create(rows, path, "k", buckets), path


def updates(spark, pairs):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "k string, v long, at long")


def test_update_rewrites_touched_buckets_only(spark):
    ledger, path = make(spark)
    before, folders = files(path), ledger.folders()
    target = folders[0][0]
    few = [r.k for r in ledger.read().filter(ledger.bucket() == target).select("k").limit(20).collect()]
    ledger.merge(1, updates(spark, [(k, -1) for k in few] + [(k, -2) for k in few]), ["v"], ["at"])
    after = files(path)
    new = set(after) - set(before)
    assert new and all(f"batch=1/_bucket={target}/" in p for p in new)
    assert {p: after[p] for p in before} == before
    assert [f for f in ledger.folders() if f[0] != target] == [f for f in folders if f[0] != target]
    want = sorted((str(i), -2 if str(i) in few else i, "x") for i in range(2000))
    assert sorted(map(tuple, ledger.read().collect())) == want


def test_committed_batch_does_nothing_and_dead_batch_runs_again(spark):
    ledger, path = make(spark, 200, 4)
    change = updates(spark, [("7", 70)])
    put, ledger._commit = ledger._commit, lambda *_: (_ for _ in ()).throw(OSError("died"))
    with pytest.raises(OSError):
        ledger.merge(1, change, ["v"], ["at"])
    assert ledger.version() == 0 and ledger.read().filter("k = '7'").first().v == 7
    ledger._commit = put
    ledger.merge(1, change, ["v"], ["at"])
    state = files(path)
    ledger.merge(1, updates(spark, [("7", 99)]), ["v"], ["at"])
    ledger.append(ledger.read(), 1)
    assert files(path) == state
    assert BucketLedger(spark, path).read().filter("k = '7'").first().v == 70
    assert ledger.read().count() == 200


def test_append_repeats_nulls_and_deletes(spark, rows):
    path = scratch_path(spark, "buckets")
    ledger = BucketLedger.create(spark.createDataFrame([], SCHEMA), path, "k", 8)
    assert ledger.read().count() == 0 and ledger.folders() == []
    ledger.append(spark.createDataFrame([(None, 1, "a"), ("p", 2, "b"), ("p", 2, "b"), ("q", 3, None)], SCHEMA), 1)
    ledger.append(spark.createDataFrame([("p", 4, "c"), (None, None, None)], SCHEMA), 2)
    ledger.merge(3, updates(spark, [("p", 9), (None, 8), ("unknown", 5)]), ["v"], ["at"],
                 spark.createDataFrame([("q",), (None,), ("q",)], "k string"))
    want = [(None, 1, "a"), (None, None, None), ("p", 9, "b"), ("p", 9, "b"), ("p", 9, "c")]
    assert rows(ledger.read()) == sorted(want, key=repr)
    ledger.merge(4, deletes=ledger.read().select("k"))
    assert rows(ledger.read()) == sorted(want[:2], key=repr)
    ledger.merge(5, deletes=spark.createDataFrame([], "k string"))
    assert ledger.version() == 5 and rows(ledger.read()) == sorted(want[:2], key=repr)


def test_hot_key_and_vacuum(spark):
    ledger, path = make(spark, 300, 4)
    hot = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("v"), F.lit(None).cast("string").alias("bucket"))
    ledger.append(hot, 1)
    ledger.merge(2, updates(spark, [("hot", 5), ("hot", 6)]), ["v"], ["at"])
    ledger.merge(3, deletes=spark.createDataFrame([("0",)], "k string"))
    want = sorted(map(tuple, ledger.read().collect()), key=repr)
    assert sum(r[0] == "hot" and r[1] == 6 for r in want) == 3000 and len(want) == 3299
    ledger.vacuum(1)
    assert sorted(map(tuple, ledger.read().collect()), key=repr) == want
    live = {f"batch={n}/_bucket={b}" for b, n in ledger.folders()}
    assert sorted(p.name for p in pathlib.Path(path, "commits").iterdir() if p.name.isdigit()) == ["3"]
    assert not any("batch=1/" in p for p in files(path)) and all(any(x in p for p in files(path)) for x in live)
    assert ledger.folders(3) == ledger.folders()


def test_arguments(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for key, buckets in (("nope", 4), ("k", 0)):
        with pytest.raises(ValueError):
            BucketLedger.create(empty, scratch_path(spark, "buckets"), key, buckets)
