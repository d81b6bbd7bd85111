"""Growing logs, the keyed store, and outcomes of tasks as a stream."""

import io
import random

import pytest
from pyspark.sql import functions as F

from jobtrail.functions.parsing import extract_app_ids
from jobtrail.session import scratch_path
from jobtrail.streaming import follow as S
from jobtrail.streaming import tail
from jobtrail.streaming.store import KeyedStore


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_every_line_lies_in_one_range(monkeypatch, block):
    """Any cuts of a file, at any byte, give each complete line once with the place it starts at."""
    monkeypatch.setattr(tail, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(150):
        data = b"".join(rng.choice([b"", b"a", b"xyz", b"longer line \xc3\xa9"]) + b"\n" for _ in range(rng.randrange(6)))
        data += rng.choice([b"", b"open end"])
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
        got = [pair for a, b in zip(cuts, cuts[1:]) for places, lines in tail.lines_ending_in(io.BytesIO(data), a, b)
               for pair in zip(places, lines)]
        expected, at = [], 0
        for line in data.split(b"\n")[:-1]:
            expected.append((at, line))
            at += len(line) + 1
        assert got == expected


def test_a_file_grows_between_triggers(spark, tmp_path):
    root, out, mark = tmp_path / "in", scratch_path(spark, "test-tail"), scratch_path(spark, "test-tail-mark")
    log = root / "stderr" / "2015-07-01" / "MR.a_12-30-45-123.log"
    log.parent.mkdir(parents=True)

    def add(text, to=log):
        with open(to, "ab") as f:
            f.write(text)

    def run():
        S.stream_growing_app_ids(spark, str(root), split_bytes=50).writeStream.format("parquet").option(
            "checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["appid"][-2:] for r in spark.read.parquet(out).collect())

    word = b"Submitted application application_1700000000000_00"
    add(word + b"01\nnoise\n" + word[:30])
    assert run() == ["01"]
    add(word[30:] + b"02\r\n" + word + b"03")     # the last line is not complete
    assert run() == ["01", "02"]
    assert run() == ["01", "02"]                   # nothing new, the stream starts again
    other = log.parent / "SK.b_12-30-45-124.log"
    add(b"\n")
    add(word + b"04\n", other)
    (log.parent / "_hidden.log").write_bytes(word + b"99\n")
    assert run() == ["01", "02", "03", "04"]


def test_offsets_and_ranges(tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * 25)
    (tmp_path / "empty.log").write_bytes(b"")
    reader = tail.TailReader(str(tmp_path), 10)
    end = reader.latestOffset()
    assert list(end.values()) == [25] and tail.TailReader(str(tmp_path / "none"), 10).latestOffset() == {}
    name = next(iter(end))
    assert [(r.begin, r.end) for r in reader.partitions({name: 3}, end)] == [(3, 13), (13, 23), (23, 25)]
    assert reader.partitions(end, end) == [] and reader.partitions({name: 40}, end) == []


def updates(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, t int")


def state(store, before=None):
    df = store.read(before)
    return {} if df is None else {r["k"]: r["v"] for r in df.collect()}


def test_store_reads_few_files_however_long_it_runs(spark):
    path = scratch_path(spark, "test-store")
    store = KeyedStore(spark, path, "k", ["t"], compact_every=10)
    expected, counts = {}, []
    rng = random.Random(2)
    for batch in range(50):
        rows = [(f"k{rng.randrange(12)}", batch * 10 + j, rng.randrange(100)) for j in range(3)]
        rows = list({r[0]: r for r in rows}.values())
        for k, v, t in rows:
            if t >= expected.get(k, (0, -1))[1]:
                expected[k] = (v, t)
        store.write(updates(spark, rows), batch)
        counts.append(len(store.sources()))
    assert state(store) == {k: v for k, (v, _) in expected.items()}
    assert max(counts) <= 11 and counts[-1] == 1
    # Old files are gone: the last snapshot, the one before, and the deltas between.
    assert store._numbers("snapshot") == [39, 49] and store._numbers("delta") == list(range(40, 50))


def test_store_survives_a_crash_between_snapshot_and_pointer(spark, monkeypatch):
    path = scratch_path(spark, "test-store")
    store = KeyedStore(spark, path, "k", compact_every=3)
    for batch in range(5):
        store.write(updates(spark, [("a", batch, 0), (f"b{batch}", batch, 0)]), batch)
    before = state(store)

    def crash(batch_id):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_point", crash)
        with pytest.raises(RuntimeError):
            store.write(updates(spark, [("a", 5, 0)]), 5)
    assert store._numbers("snapshot") == [2, 5] and store._numbers("pointer") == [2]
    assert state(store, before=5) == before
    store.write(updates(spark, [("a", 6, 0)]), 5)  # the retry of the batch
    assert state(store) == {**before, "a": 6} and store._numbers("pointer") == [2, 5]
    # A retry after the pointer still finds what was there before the batch.
    assert state(store, before=5) == before
    store.write(updates(spark, [("a", 6, 0)]), 5)
    assert state(store) == {**before, "a": 6}


def test_store_deletes_and_forgets(spark):
    store = KeyedStore(spark, scratch_path(spark, "test-store"), "k", compact_every=2, keep_batches=3)
    store.write(updates(spark, [("a", 1, 0), ("b", 1, 0), ("c", 1, 0)]), 0)
    store.write(updates(spark, [("a", 2, 0)]).withColumn("_gone", F.lit(True)), 1)
    assert state(store) == {"b": 1, "c": 1}
    for batch in range(2, 6):
        store.write(updates(spark, [("b", batch, 0)]), batch)
    assert state(store) == {"b": 5}


def test_status_is_latest_after_many_batches(spark, rows):
    source, deltas, mark = (scratch_path(spark, f"test-{n}") for n in ("in", "deltas", "mark"))
    table = spark.createDataFrame([("a", "RUNNING"), ("b", "RUNNING"), ("c", "RUNNING")], "otid string, status string")
    assert rows(S.current_status(table, deltas, "otid", ["status"], ["n"])) == rows(table)
    for n in range(12):
        spark.createDataFrame([("ab"[n % 2], f"s{n}", n if n != 10 else 3)], "otid string, status string, n int").coalesce(
            1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("otid string, status string, n int").option("maxFilesPerTrigger", 1).parquet(source)
    S.stream_status(stream, deltas, mark, "otid", ["status"], ["n"], compact_every=4).awaitTermination()
    assert rows(S.current_status(table, deltas, "otid", ["status"], ["n"])) == [("a", "s8"), ("b", "s11"), ("c", "RUNNING")]
    assert len(KeyedStore(spark, deltas, "otid", ["n"]).sources()) == 1


def app(task, stream, n):
    return (task, stream, n, f"Submitted application application_1700000000000_{n:04d}", None)


def end(task, submission):
    return (task, "end", None, None, submission)


EVENT = "otid string, stream string, n int, line string, submission string"


def run_tasks(spark, folders, steps, **kw):
    source, out, mark = folders
    for step in steps:
        spark.createDataFrame(step, EVENT).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    ids = extract_app_ids(events.filter("stream <> 'end'")).drop("line").unionByName(
        events.filter("stream = 'end'").drop("line"), allowMissingColumns=True)
    S.stream_tasks(ids, out, mark, ["n"], **kw).awaitTermination()
    return {r["otid"]: (r["n_apps"], r["last_appid"] and int(r["last_appid"][-4:])) for r in spark.read.parquet(f"{out}/ended").collect()}


def test_tasks_end_with_their_last_application(spark):
    folders = [scratch_path(spark, f"test-{n}") for n in ("in", "out", "mark")]
    found = run_tasks(spark, folders, [
        [app("a", "stderr", 1), app("b", "stdout", 2), app("c", "stdout", 3), app("d", "stdout", 9)],
        [app("a", "stderr", 5), app("a", "stdout", 8), app("b", "stdout", 6), end("d", "sync"), end("e", "sync")],
        [app("a", "stderr", 4), end("a", "async"), end("b", "sync"), end("c", "async")],
    ])
    # On stderr; on stdout of a sync task; on stdout of an async one; ended in the next batch; without any line.
    assert found == {"a": (3, 5), "b": (2, 6), "c": (0, None), "d": (1, 9), "e": (0, None)}


def test_state_follows_open_tasks(spark):
    """Fifty batches in which tasks come and go leave as many rows as there are open tasks."""
    folders = [scratch_path(spark, f"test-{n}") for n in ("in", "out", "mark")]
    steps = [[app(f"t{k}", "stderr", 2 * k), app("open", "stderr", 1000 + k), *([end(f"t{k - 2}", "sync")] if k > 1 else [])] for k in range(50)]
    found = run_tasks(spark, folders, steps, compact_every=5)
    assert len(found) == 48 and found["t7"] == (1, 14)
    store = KeyedStore(spark, f"{folders[1]}/open", "otid", compact_every=5)
    rows = {r["otid"]: r["n_err"] for r in store.read().collect()}
    assert rows == {"open": 50, "t48": 1, "t49": 1}
    assert spark.read.parquet(*store.sources()).count() == 3


def test_state_is_merged_once_a_batch(spark, monkeypatch):
    """A batch that ends in a snapshot writes it from the state it has joined, without a delta or a second merge."""
    calls, merged = [], KeyedStore._merged
    monkeypatch.setattr(KeyedStore, "_merged", lambda self, before: calls.append(before) or merged(self, before))
    folders = [scratch_path(spark, f"test-{n}") for n in ("in", "out", "mark")]
    found = run_tasks(spark, folders, [
        [app("a", "stderr", 1), app("b", "stderr", 2)], [app("a", "stderr", 3), end("d", "sync")],
        [app("a", "stderr", 4)], [end("b", "sync"), app("c", "stderr", 5)], [end("a", "sync"), end("c", "async")]], compact_every=2)
    assert found == {"a": (3, 4), "b": (1, 2), "c": (1, 5), "d": (0, None)}
    assert calls == [0, 1, 2, 3, 4]
    store = KeyedStore(spark, f"{folders[1]}/open", "otid", compact_every=2)
    assert store._numbers("snapshot") == [1, 3] and store._numbers("delta") == [2, 4]
    assert store.read().count() == 0
