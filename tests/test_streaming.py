import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobtrail.functions.parsing import extract_app_ids
from jobtrail.operators.keys import apply_updates
from jobtrail.operators.ledger import number_apps
from jobtrail.session import scratch_path
from jobtrail.streaming import follow as S
from jobtrail.streaming.store import KeyedStore

LINE = "otid string, ts timestamp_ntz, n int, line string"


def batch(spark, *rows):
    data = [(t, f"2024-01-01 00:00:{s:02d}", s, f"Submitted application application_1700000000000_{a:04d}") for t, s, a in rows]
    df = spark.createDataFrame(data, "otid string, ts string, n int, line string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def run_ledger(spark, folders, df, **kw):
    source, out, mark = folders
    df.write.mode("append").parquet(source)
    ids = extract_app_ids(spark.readStream.schema(LINE).parquet(source))
    S.stream_ledger(ids, out, mark, ["ts", "n"], **kw).awaitTermination()
    return spark.read.parquet(f"{out}/ledger").drop("batch")


def test_ledger_stream_equals_batch_and_ignores_replays(spark, rows):
    folders = [scratch_path(spark, f"test-{n}") for n in ("in", "out", "mark")]
    steps = [
        batch(spark, ("a", 1, 11), ("a", 2, 12), ("b", 1, 21)),
        batch(spark, ("a", 3, 13), ("a", 2, 12), ("c", 4, 31)),   # one line delivered again
        batch(spark, ("b", 5, 22), ("a", 1, 11), ("a", 9, 14)),
        batch(spark, ("c", 6, 32)),
    ]
    seen = None
    for step in steps:
        # Small limits force the split path and frequent snapshots of the heads.
        out = run_ledger(spark, folders, step, snapshot_every=2, group_limit=1)
        seen = step if seen is None else seen.unionByName(step)
        twin = number_apps(extract_app_ids(seen.distinct()), ["ts", "n"])
        cols = ["otid", "sequence", "appid"]
        assert rows(out, *cols) == rows(twin, *cols)
    closed = {(r["otid"], r["sequence"]): r["end_ts"] for r in S.close_intervals(out).collect()}
    assert closed[("a", 4)] is None and closed[("a", 1)].second == 2 and closed[("b", 1)].second == 5


def test_ledger_stream_keeps_no_state_beside_the_ledger(spark, rows, monkeypatch):
    """Lines are known again by the ledger, read from the first to the last batch whose times meet the batch."""
    folders = [scratch_path(spark, f"test-{n}") for n in ("in", "out", "mark")]
    known, before = [], S._known_before
    monkeypatch.setattr(S, "_known_before", lambda *a: known.append(before(*a)) or known[-1])
    none = spark.createDataFrame([("a", None, 7, "Submitted application application_1700000000000_0007"),
                                  (None, None, 8, "Submitted application application_1700000000000_0008")], LINE)
    steps = [
        batch(spark, ("a", 1, 11), ("a", 2, 12), ("a", 2, 12), ("b", 3, 21)).unionByName(none),
        batch(spark, ("a", 4, 13), ("c", 4, 31), ("c", 4, 31)),  # later than all before
        batch(spark, ("a", 4, 13), ("b", 5, 22)),                 # meets the second batch only
        batch(spark, ("z", 0, 99)).limit(0),
        none,                                                     # meets the first by its open times
        batch(spark, ("a", 2, 12), ("a", 6, 14), ("b", 0, 23)),   # spans all; a line comes before those numbered
    ]
    for step in steps:
        out = run_ledger(spark, folders, step, snapshot_every=2)
    near = [None if k is None else sorted({int(f.split("batch=")[1].split("/")[0]) for f in k.inputFiles() if "/ledger/" in f}) for k in known]
    assert near == [None, None, [1], None, [0], [0, 1, 2]]
    assert rows(out, "otid", "sequence", "appid") == sorted([
        *[(t, k, f"application_1700000000000_{a:04d}") for t, k, a in (
            ("a", 1, 7), ("a", 2, 11), ("a", 3, 12), ("a", 4, 13), ("a", 5, 14), ("b", 1, 21), ("b", 2, 22), ("b", 3, 23), ("c", 1, 31))],
        (None, 1, "application_1700000000000_0008")], key=repr)
    kept = Path(re.sub("^file:/+", "/", folders[2]))
    assert (kept / "offsets").is_dir() and not (kept / "state").exists()


@pytest.mark.parametrize("steps", [3, 4])
def test_a_ledger_batch_can_be_run_again(spark, rows, steps):
    """A batch whose commit is lost runs again, whether or not it ends in a snapshot of the heads."""
    folders = [scratch_path(spark, f"test-{n}") for n in ("in", "out", "mark")]
    for k in range(steps):
        out = run_ledger(spark, folders, batch(spark, ("a", k, k), ("b", 1, 50), ("b", k + 20, k + 20)), snapshot_every=2)
    first = rows(out, "otid", "sequence", "appid")
    kept = Path(re.sub("^file:/+", "/", folders[2]))
    for f in (f"{steps - 1}", f".{steps - 1}.crc"):
        (kept / "commits" / f).unlink(missing_ok=True)
    again = run_ledger(spark, folders, batch(spark, ("z", 0, 99)), snapshot_every=2)
    assert len(first) == 2 * steps + 1
    assert rows(again, "otid", "sequence", "appid") == [*first, ("z", 1, "application_1700000000000_0099")]
    heads = KeyedStore(spark, f"{folders[1]}/heads", "otid", compact_every=2)
    assert heads._numbers("pointer")[-1] == 2 * ((steps + 1) // 2) - 1 and heads._numbers("delta") == []


def test_intervals_take_one_shuffle_unless_a_task_is_huge(spark, rows):
    times = batch(spark, ("a", 1, 11), ("a", 2, 12), ("b", 5, 21), (None, 3, 31), (None, 4, 32)).select("otid", "ts", "n")
    numbered = times.withColumn("sequence", F.when(F.col("n").isin(2, 4), 2).otherwise(1))
    small, huge = S.close_intervals(numbered), S.close_intervals(numbered, group_limit=1)
    assert rows(small, "otid", "sequence", "end_ts") == rows(huge, "otid", "sequence", "end_ts")
    assert {(r["otid"], r["sequence"]): r["end_ts"] and r["end_ts"].second for r in small.collect()} == {
        ("a", 1): 2, ("a", 2): None, ("b", 1): None, (None, 1): 4, (None, 2): None}
    plan = S.close_intervals(numbered)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_app_id_stream(spark, rows, tmp_path):
    def write(name, text):
        folder = tmp_path / "in" / "stderr" / "2015-07-01"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    out, mark = scratch_path(spark, "test-ids"), scratch_path(spark, "test-ids-mark")

    def run():
        S.stream_app_ids(spark, str(tmp_path / "in")).writeStream.format("parquet").option(
            "checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return rows(spark.read.parquet(out), "otid", "stream", "appid")

    write("MR.a_12-30-45-123.xml", "noise\nSubmitted application application_1700000000000_0001\n")
    first = [("MR.a2015-07-01_12-30-45-123", "stderr", "application_1700000000000_0001")]
    assert run() == first
    write("SK.b_12-30-45-124.xml", "Submitted application application_1700000000000_12345\n")
    assert run() == first + [("SK.b2015-07-01_12-30-45-124", "stderr", "application_1700000000000_12345")]


def test_status_stream_equals_batch(spark, rows):
    source, deltas, mark = (scratch_path(spark, f"test-{n}") for n in ("status", "deltas", "status-mark"))
    table = spark.createDataFrame([("a", "RUNNING"), ("b", "RUNNING"), ("c", "RUNNING")], "otid string, status string")
    schema = "otid string, status string, at int"
    seen = None
    for data in ([("a", "FAILED", 5), ("a", "SUCCEEDED", 7)], [("a", "KILLED", 6), ("b", None, 1)], [("zz", "X", 1)]):
        step = spark.createDataFrame(data, schema)
        step.write.mode("append").parquet(source)
        seen = step if seen is None else seen.unionByName(step)
        stream = spark.readStream.schema(schema).parquet(source)
        S.stream_status(stream, deltas, mark, "otid", ["status"], ["at"]).awaitTermination()
        now = S.current_status(table, deltas, "otid", ["status"], ["at"])
        assert rows(now) == rows(apply_updates(table, seen, "otid", ["status"], ["at"]))


def test_steps_of_the_stream_queries_hold_every_row(spark, rows):
    from jobtrail.plans.streaming_queries import in_steps

    times = [None, "1850-01-01", "1996-12-31", "1997-01-01", "1999-01-01", "2100-01-01", "2500-01-01"]
    df = spark.createDataFrame(list(enumerate(times)), "n int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [[n for n, in rows(step, "n")] for step in in_steps(df, "ts")] == [[0, 1, 2], [3], [4, 5, 6]]
