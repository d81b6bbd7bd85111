"""The registry after a mixed batch, against a fold of the events one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from jobtrail.operators import registry as G

MESSAGES = {G.REGISTER: "'%s' exists", G.UPDATE: "no '%s'", G.DELETE: "no '%s' to delete"}
EVENT = "name string, kind string, n int, note string, author string, error string"


def fold(events, registry):
    """Every event in order on a dict."""
    names, told = {k: (note, author) for k, note, author in registry}, []
    for name, kind, n, note, author, error in sorted(events, key=lambda e: e[2]):
        present = name in names
        if error:
            reason = error
        elif (kind == G.REGISTER) == present:
            reason = MESSAGES[kind] % name
        else:
            reason = ""
            if kind == G.REGISTER:
                names[name] = (note, author)
            elif kind == G.UPDATE:
                names[name] = (note, names[name][1])
            else:
                del names[name]
        told.append((n, reason))
    return told, sorted(((k, *v) for k, v in names.items()), key=repr)


def run(spark, events, registry, **kw):
    df, old = spark.createDataFrame(events, EVENT), spark.createDataFrame(registry, "name string, note string, author string")
    judged = G.judge_events(df, old, "name", "n", MESSAGES, **kw)
    after = G.registry_after(judged, old, "name", ["note"], ["author"])
    assert judged.count() == len(events)
    return sorted((r["n"], r["reason"]) for r in judged.collect()), sorted(map(tuple, after.select("name", "note", "author").collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"group_limit": 20, "block": 7}, {"group_limit": 5, "block": 1}])
def test_mixed_batch_against_a_fold(spark, limits):
    """A third of all events share a name; small limits spread it over partitions and blocks."""
    rng = random.Random(len(limits))
    kinds = [G.REGISTER, G.UPDATE, G.UPDATE, G.DELETE]
    events = [("busy" if k % 3 == 0 else f"f{rng.randrange(25)}", rng.choice(kinds), k, rng.choice([f"note{k}", None]), f"author{k}",
               rng.choice(["", "", "", "too long"])) for k in range(300)]
    registry = [("busy", "old", "me"), ("f3", "old", None), ("f7", None, "you"), ("never touched", "x", "y")]
    told, after = run(spark, events, registry, **limits)
    expected, names = fold(events, registry)
    assert told == sorted(expected) and after == names
    assert {r for _, r in told} >= {"", "too long", "'busy' exists", "no 'busy'"}


def test_first_event_meets_the_registry(spark):
    events = [("a", G.UPDATE, 1, "new", "x", ""), ("b", G.UPDATE, 2, "new", "x", ""), ("a", G.DELETE, 3, None, None, ""),
              ("a", G.UPDATE, 4, "late", "x", ""), ("a", G.REGISTER, 5, "again", "z", ""), ("c", G.DELETE, 6, None, None, "bad")]
    told, after = run(spark, events, [("a", "old", "me"), ("c", "old", "me")])
    assert [r for _, r in told] == ["", "no 'b'", "", "no 'a'", "", "bad"]
    assert after == [("a", "again", "z"), ("c", "old", "me")]


def test_empty_batch_and_empty_registry(spark):
    assert run(spark, [], [("a", "x", "y")]) == ([], [("a", "x", "y")])
    assert run(spark, [("a", G.REGISTER, 1, "n", "me", "")], []) == ([(1, "")], [("a", "n", "me")])


@pytest.mark.parametrize("block", [1, 3, 100])
def test_last_before_crosses_blocks(spark, block):
    rows = [(k, n, rng) for k in ("a", None) for n, rng in enumerate([None, 5, None, None, None, None, 7, None], 1)]
    df = spark.createDataFrame(rows, "k string, n bigint, v int")
    got = {(r["k"], r["n"]): r["before"] for r in G.last_before(df, ["k"], "n", "v", "before", block).collect()}
    assert [got["a", n] for n in range(1, 9)] == [None, None, 5, 5, 5, 5, 5, 7] == [got[None, n] for n in range(1, 9)]


def test_a_busy_name_is_not_gathered(spark):
    judged = spark.range(10).select(F.lit("busy").alias("name"), F.lit("update").alias("kind"), F.col("id").alias("_n"),
                                    F.lit("x").alias("note"), F.lit("y").alias("author"), F.lit("").alias("reason"))
    plan = G.registry_after(judged, spark.createDataFrame([("busy", "a", "b")], "name string, note string, author string"), "name",
                            ["note"], ["author"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
