import datetime as dt
import glob
import gzip
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobtrail.operators.ledger import task_logs
from jobtrail.plans.registry import Tables
from jobtrail.plans.source_queries import container_logs
from jobtrail.session import scratch_path, shared_dir, stage
from jobtrail.sources import files, logs, sinks, tables

STAMP = "2015-07-01_12-30-45-123\t"


def section(name, text):
    return (f"{STAMP}LogType: \n{STAMP}{name}\n{STAMP}LogLength: \n{STAMP}{len(text.encode())}\n{STAMP}Log Contents:\n"
            f"{text}{STAMP}\n")


def container_log(seed, containers):
    """A log file as written section by section, and the rows it holds."""
    rnd = random.Random(seed)
    out, rows, number = [], [], 0
    for c in range(containers):
        key, node = f"container_1700000000000_{seed:04d}_01_{c:06d}", f"node{rnd.randrange(3)}_80"
        out.append(f"{STAMP}\n\nContainer: {key} on {node}\n{STAMP}{'=' * 30}\n")
        for name in ("stderr", "stdout", "syslog")[: rnd.randrange(4)]:
            number += 1
            lines = [rnd.choice(["", "plain words", "LogType: not a header", "a\tb", "x" * rnd.randrange(200), f"ends in {STAMP}",
                                 f"{STAMP}LogType: ", "Container: container_1_1_01_1 on nowhere", section("inner", "z" * 30)])
                     for _ in range(rnd.randrange(6))]
            text = "\n".join(lines) + rnd.choice(["", "\n"]) if lines else ""
            out.append(section(name, text))
            body = text.split("\n")
            if body and body[-1] == "":
                body.pop()
            if not text:
                rows.append((node, key, number, name, 0, 0, None))
            rows += [(node, key, number, name, len(text), i + 1, line) for i, line in enumerate(body)]
    return "".join(out), rows


def test_container_logs_across_splits(spark, rows, tmp_path):
    expected = []
    for seed in range(4):
        text, part = container_log(seed, 12)
        (tmp_path / f"node_{seed}.log").write_text(text)
        expected += part
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    cols = ["node", "container", "section", "log_type", "log_length", "line_no", "line"]
    try:
        for size in ("134217728", "700", "97"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            got = rows(logs.read_container_logs(spark, str(tmp_path)), *cols)
            assert got == sorted(expected, key=repr), size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("fan", [2, 5])
def test_container_logs_by_composed_ranges(spark, rows, tmp_path, fan):
    """Many ranges in one file, sections over several of them and over groups of them, false headers at any place."""
    rnd = random.Random(fan)
    out, expected, node, key = [f"{STAMP}\n\nContainer: c_0 on n_0\n{STAMP}====\n"], [], "n_0", "c_0"
    for number in range(1, 40):
        false = section("inner", "y" * rnd.randrange(900)) + f"Container: c_x on n_x\n{STAMP}LogType: \n"
        lines = [rnd.choice(["a", false[:rnd.randrange(1, len(false))], false, "w" * rnd.randrange(400)]) for _ in range(rnd.randrange(9))]
        text = "\n".join(lines)
        if rnd.random() < 0.4:
            node, key = f"n_{number}", f"c_{number}"
            out.append(f"Container: {key} on {node}\n")
        out.append(section("stdout", text))
        body = text.split("\n") if text else []
        body = body[:-1] if body and not body[-1] else body
        expected += [(node, key, number, len(text), i + 1, line) for i, line in enumerate(body)] or [(node, key, number, 0, 0, None)]
    (tmp_path / "node.log").write_text("".join(out))
    got = logs.read_container_logs(spark, str(tmp_path), range_bytes=211, fan=fan)
    assert rows(got, "node", "container", "section", "log_length", "line_no", "line") == sorted(expected, key=repr)


def test_container_logs_ignore_a_changed_split_size(spark, rows, tmp_path):
    text, expected = container_log(9, 40)
    (tmp_path / "node_9.log").write_text(text)
    cols = ["node", "container", "section", "log_type", "log_length", "line_no", "line"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        built = logs.read_container_logs(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        assert rows(built, *cols) == sorted(expected, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_container_logs_from_compressed_and_cut_files(spark, rows, tmp_path):
    text, expected = container_log(5, 10)
    with gzip.open(tmp_path / "node_5.log.gz", "wt", newline="") as f:
        f.write(text)
    head = f"{STAMP}\n\nContainer: c_1 on n_1\n{STAMP}====\n"
    (tmp_path / "cut_text").write_text(head + section("stdout", "caf\u00e9\r\nrest of it")[:-30])
    (tmp_path / "cut_header").write_text(head + f"{STAMP}LogType: \n{STAMP}stdout\n{STAMP}LogLength: \n{STAMP}9\n{STAMP}Log Contents:\n")
    (tmp_path / "no_length").write_text(head + f"{STAMP}LogType: \n{STAMP}stdout\n{STAMP}LogLength: \n{STAMP}x\n{STAMP}Log Contents:\nz\n")
    cols = ["node", "container", "section", "log_type", "log_length", "line_no", "line"]
    size = len("caf\u00e9\r\nrest of it".encode())
    expected += [("n_1", "c_1", 1, "stdout", size, 1, "caf\u00e9\r"), ("n_1", "c_1", 1, "stdout", size, 2, "rest "),
                 ("n_1", "c_1", 1, "stdout", 9, 0, None)]
    assert rows(logs.read_container_logs(spark, str(tmp_path)), *cols) == sorted(expected, key=repr)


def test_container_logs_stage_ranges_and_no_headers(spark, tmp_path):
    text = "".join(container_log(seed, 300)[0] for seed in range(4))
    (tmp_path / "node.log").write_text(text)
    assert logs.read_container_logs(spark, str(tmp_path), range_bytes=20_000).count() > 1000
    staged = max(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/jobtrail/log-ranges-*"), key=os.path.getmtime)
    ranges = -(-len(text.encode()) // 20_000)
    sizes = spark.read.parquet(staged).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    assert sizes[0] == ranges and sizes[1] < 1000 * ranges


def test_written_container_logs_are_compressed(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    container_logs(t)
    root = max(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/jobtrail/container-logs-*"), key=os.path.getmtime)
    found = files.list_files(spark, root, "part-*").agg(F.sum("size_bytes")).first()[0]
    assert found < 150 * t.app_v.count()


def test_log_rows_are_never_the_broadcast_side(spark):
    def lines(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict({"appid": [f"a{i}"] * 10, "line": ["x" * 100] * 10})

    sections = spark.range(50).repartition(4).mapInArrow(lines, "appid string, line string")
    keys = spark.range(20).selectExpr("concat('j', id) as jobinstanceid", "'GM.op' as opid")
    optask = keys.selectExpr("*", "concat('t', jobinstanceid) as otid", "timestamp_ntz'2020-01-01' as submit_ts")
    apps = spark.range(20).selectExpr("concat('tj', id) as otid", "1 as sequence", "concat('a', id) as appid")
    found = task_logs(keys, optask, apps, sections)
    assert found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and not re.search(r"BroadcastExchange[^\n]*\n[^\n]*(\n[^\n]*)?MapInArrow", plan)


def test_container_to_application(spark):
    df = spark.createDataFrame(
        [("container_1700000000000_0042_01_000001",), ("container_e17_1700000000000_12345_02_000001",), ("x",)], "c string")
    assert [r[0] for r in df.select(logs.application_of_container(F.col("c"))).collect()] == [
        "application_1700000000000_0042", "application_1700000000000_12345", None]


def test_task_logs_from_plain_files(spark, rows, tmp_path):
    for stream, name, text in (
        ("stderr", "MR.op a_12-30-45-123.xml", "one\ntwo\n"), ("stdout", "MR.op a_12-30-45-123.txt", "three\n"),
        ("stdout", "notes.txt", "ignored\n"),
    ):
        folder = tmp_path / stream / "2015-07-01"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    df = logs.read_task_logs(spark, str(tmp_path))
    task = "MR.op a2015-07-01_12-30-45-123"
    assert rows(df, "otid", "opid", "stream", "log_date", "line") == [
        (task, "MR.op a", "stderr", "2015-07-01", "one"), (task, "MR.op a", "stderr", "2015-07-01", "two"),
        (task, "MR.op a", "stdout", "2015-07-01", "three")]


def test_line_order_survives_splitting(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        df = logs.read_lines(spark, str(tmp_path))
        assert df.select("block").distinct().count() > 5
        got = [r["line"] for r in df.orderBy("file", "block", "row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"line {i}" for i in range(500)]


def test_log_sink_prunes_dates(spark, rows):
    path = scratch_path(spark, "test-logs")
    lines = spark.createDataFrame(
        [(f"2015-07-0{d}_00-00-00-00{i}", f"l{d}{i}") for d in range(1, 6) for i in range(3)], "stamp string, line string")
    sinks.write_logs(lines, path)
    kept = sinks.read_logs(spark, path, "2015-07-02", "2015-07-03")
    assert rows(kept, "log_date", "line") == [(f"2015-07-0{d}", f"l{d}{i}") for d in (2, 3) for i in range(3)]
    scan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in scan or "PartitionFilters: [(" in scan or "PartitionFilters: [is" in scan


def test_xml_round_trip(spark, rows):
    df = spark.createDataFrame([("a & b", "<x>"), (None, "y")], "name string, descriptor string")
    doc = df.select(sinks.to_response([F.lit("").alias("errmsg"), F.struct("name", "descriptor").alias("udf")]).alias("x"))
    schema = "errmsg string, udf struct<name string, descriptor string>"
    back = doc.select(F.from_xml("x", schema).alias("r")).select("r.errmsg", "r.udf.*")
    assert rows(back) == sorted([("", "a & b", "<x>"), ("", None, "y")], key=repr)
    path = scratch_path(spark, "test-responses")
    sinks.write_responses(df, path, "response", "udf")
    again = spark.read.format("xml").schema(df.schema).option("rowTag", "udf").load(path)
    assert rows(again) == rows(df)
    whole = spark.read.text(path, wholetext=True).first()[0].strip()
    assert whole.startswith("<response>") and whole.endswith("</response>")


def test_append(spark, rows):
    path = scratch_path(spark, "test-append")
    a = spark.createDataFrame([("x", 1)], "k string, n int")
    sinks.append(a, path)
    sinks.append(a, path)
    assert rows(spark.read.parquet(path)) == [("x", 1), ("x", 1)]
    b = spark.createDataFrame([("y",)], "k string")
    assert rows(sinks.append_rows(a, b)) == sorted([("x", 1), ("y", None)], key=repr)


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.txt").write_text("12345")
    (tmp_path / "d" / "b.txt").write_text("12")
    (tmp_path / "d" / "empty.txt").write_text("")
    (tmp_path / "c.bin").write_text("1")
    df = files.list_files(spark, str(tmp_path), "*.txt")
    got = {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["mtime"]) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.txt": 5, "b.txt": 2}
    assert all(abs((dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - v[1]).total_seconds()) < 300 for v in got.values())


def test_describe_partitioned_table(spark):
    path = scratch_path(spark, "test-table")
    spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (2, "b", "y")], "n int, s string, p string").write.partitionBy("p").parquet(path)
    spark.sql(f"create table jobtrail_described (n int, s string, p string) using parquet partitioned by (p) location '{path}'")
    try:
        spark.catalog.recoverPartitions("jobtrail_described")
        got = tables.describe_table(spark, "jobtrail_described", ndv="exact").collect()
        assert [(r["name"], r["type"], r["ispart"]) for r in got] == [
            ("n", "int", "FALSE"), ("s", "string", "FALSE"), ("p", "string", "TRUE")]
        assert [(r["count"], r["nulls"], r["min"], r["max"], r["ndv"]) for r in got] == [
            (3, 0, "1", "2", 2), (2, 1, "a", "b", 2), (3, 0, "x", "y", 2)]
        assert tables.partition_columns(spark, "jobtrail_described") == ["p"]
    finally:
        spark.sql("drop table jobtrail_described")


def test_jdbc_scan_is_split_by_ranges():
    options = tables.jdbc_options("jdbc:x://h/db", "optask", "id", 0, 1000, 8)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8"
    assert "partitionColumn" not in tables.jdbc_options("jdbc:x://h/db", "optask")


def test_shared_folder_comes_from_the_session():
    class Session:
        def __init__(self, folder, master):
            self.conf, self.sparkContext = self, self
            self.folder, self.master = folder, master

        def get(self, name, default):
            assert name == "spark.checkpoint.dir"
            return self.folder or default

        def set(self, name, value):
            self.folder = value

    assert shared_dir(Session("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        shared_dir(Session(None, "yarn"))
    local = Session(None, "local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_staging_uses_the_shared_folder(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    staged = stage(df, "test-stage")
    assert rows(staged) == rows(df)
    assert all(f.split(":", 1)[1].replace("//", "").startswith(shared_dir(spark).split(":")[-1].replace("//", ""))
               for f in staged.inputFiles())
