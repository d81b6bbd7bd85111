"""Numbering in groups: the split path for huge keys must equal the window path."""

import random

import pytest
from pyspark.sql import functions as F

from jobtrail.operators.ordered import first_by_position, group_bound, largest_group, last_by_position, sequence_rows

SCHEMA = "k string, ts int, tie int, v string"


def skewed(n=3000, seed=1):
    """A third of the rows under one key, many of them at one time, and a NULL key."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rnd.randrange(200)}"
        ts = 5 if key == "hot" and i % 2 else rnd.randrange(50)
        out.append((key, ts, i, f"v{i}"))
    rnd.shuffle(out)
    return out


def brute(rows, ahead=1):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    out = []
    for group in groups.values():
        group.sort(key=lambda r: (r[1], r[2]))
        for i, row in enumerate(group):
            nxt = group[i + ahead][3] if i + ahead < len(group) else None
            out.append((*row, i + 1, nxt))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10_000, 100, 40])
@pytest.mark.parametrize("ahead", [1, 3])
def test_split_path_equals_brute_force(spark, rows, limit, ahead):
    data = skewed()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    out = sequence_rows(df, ["k"], ["ts", "tie"], following={"nxt": ("v", ahead)}, group_limit=limit)
    assert rows(out, "k", "ts", "tie", "v", "sequence", "nxt") == brute(data, ahead)


@pytest.mark.parametrize("limit", [10_000, 100, 40])
def test_rows_that_come_again_are_numbered_once(spark, rows, limit):
    data = skewed()
    df = spark.createDataFrame([*data, *data[::3], *data[::3], *data[:50]], SCHEMA).repartition(7)
    out = sequence_rows(df, ["k"], ["ts", "tie"], following={"nxt": ("v", 1)}, group_limit=limit, once=True)
    assert rows(out, "k", "ts", "tie", "v", "sequence", "nxt") == brute(data)
    plan = sequence_rows(df, ["k"], ["ts", "tie"], once=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Window [") == plan.count("Sort [") == 1


def test_shares_bound_the_largest_group(spark):
    df = spark.createDataFrame(skewed(), SCHEMA)
    shares = df.groupBy(group_bound(["k"], 16)).count()
    most = shares.agg(F.max("count")).first()[0]
    assert shares.count() == 16 and 1000 <= most < 1500 and shares.agg(F.sum("count")).first()[0] == 3000


def test_largest_group_and_empty(spark):
    df = spark.createDataFrame(skewed(), SCHEMA)
    assert largest_group(df, ["k"]) == 1000
    empty = df.filter("false")
    assert largest_group(empty, ["k"]) == 0
    assert sequence_rows(empty, ["k"], ["ts"]).count() == 0


def test_input_order_and_partitions_do_not_matter(spark, rows):
    data = skewed(600)
    results = []
    for parts, seed in ((1, 3), (5, 4), (13, 5)):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, SCHEMA).repartition(parts)
        results.append(rows(sequence_rows(df, ["k"], ["ts", "tie"], group_limit=150)))
    assert results[0] == results[1] == results[2]


def test_hot_key_spreads_over_tasks(spark):
    df = spark.createDataFrame(skewed(), SCHEMA).filter("k = 'hot'")
    out = sequence_rows(df, ["k"], ["ts", "tie"], group_limit=100)
    folder = next(f.rsplit("/", 1)[0] for f in out.inputFiles() if "/ranged-" in f)
    pieces = spark.read.parquet(folder).groupBy(F.shiftright("_at", 33)).count().collect()
    assert sum(r["count"] for r in pieces) == 1000
    assert max(r["count"] for r in pieces) <= 200


def test_first_and_last_by_position(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "x", False), ("a", 2, "y", True), ("a", 3, "z", True), ("b", 1, "w", False)],
        "k string, pos int, v string, ok boolean")
    assert rows(first_by_position(df, ["k"], "v", "pos", F.col("ok"))) == [("a", "y")]
    assert rows(last_by_position(df, ["k"], "v", "pos")) == [("a", "z"), ("b", "w")]
    assert rows(last_by_position(df, ["k"], "v", "pos", ~F.col("ok"))) == [("a", "x"), ("b", "w")]
