import datetime as dt

from pyspark.sql import functions as F

from jobtrail import constants as C
from jobtrail.operators import keys as K
from jobtrail.operators import ledger as L

TASKS = "otid string, opid string, submission string, status string, submit_ts int, jobinstanceid string"


def tasks(spark):
    return spark.createDataFrame([
        ("t1", "MR.a", "sync", "RUNNING", 1, "j1"), ("t2", "MR.a", "async", "RUNNING", 2, "j1"),
        ("t3", "HV.b", "sync", "RUNNING", 3, "j3"), ("t4", "GM.c", "sync", "KILLED", 4, "j4"),
        ("t5", "SK.d", "sync", "RUNNING", 5, "j5"), ("t6", "SK.d", "sync", None, 6, "j6"),
    ], TASKS)


def app(n):
    return f"application_1700000000000_{n:04d}"


def lines(spark):
    sub = "INFO Submitted application "
    return spark.createDataFrame([
        ("t1", 1, "stderr", sub + app(1)), ("t1", 2, "stderr", "noise"), ("t1", 5, "stderr", sub + app(2)),
        ("t1", 9, "stdout", sub + app(99)),                       # ignored: stderr had ids
        ("t2", 3, "stdout", sub + app(3)),                        # ignored: async task
        ("t4", 2, "stdout", sub + app(4)), ("t4", 7, "stdout", "end"),
        ("t5", 4, "stderr", "Submitted application nothing"),
    ], "otid string, ts int, stream string, line string")


def statuses(spark):
    return spark.createDataFrame([(app(1), "SUCCEEDED"), (app(2), "FAILED")], "appid string, status string")


def test_ledger_with_fallback_and_missing_status(spark, rows):
    ledger = L.build_ledger(tasks(spark), lines(spark), statuses(spark), ["ts"])
    # The last application closes with the last submission line of its task.
    assert rows(ledger.apps) == [
        ("t1", app(1), 1, 1, 5, "SUCCEEDED"), ("t1", app(2), 2, 5, 9, "FAILED"), ("t4", app(4), 1, 2, 2, "RUNNING")]
    assert rows(ledger.tasks, "otid", "n_apps", "status") == [
        ("t1", 2, "FAILED"), ("t2", 0, "FINISHED"), ("t3", 0, "FINISHED"), ("t4", 1, "RUNNING"),
        ("t5", 0, "FINISHED"), ("t6", 0, "FINISHED")]


def test_ledger_is_the_same_when_tasks_count_as_huge(spark, rows):
    small = L.build_ledger(tasks(spark), lines(spark), statuses(spark), ["ts"], group_limit=1)
    whole = L.build_ledger(tasks(spark), lines(spark), statuses(spark), ["ts"])
    assert rows(small.apps) == rows(whole.apps)
    assert rows(small.tasks) == rows(whole.tasks)


def test_final_status_keeps_a_null_status(spark, rows):
    apps = spark.createDataFrame([("t1", 1, "FAILED"), ("t1", 2, None)], "otid string, ts int, status string")
    got = dict((r[0], r[2]) for r in rows(L.final_status(tasks(spark), apps, ["ts"])))
    assert got["t1"] is None and got["t2"] == "FINISHED"


def test_hive_states(spark, rows):
    states = ["INITIALIZED_STATE", "RUNNING_STATE", "PENDING_STATE", "FINISHED_STATE", "CANCELED_STATE", "CLOSED_STATE",
              "ERROR_STATE", "UKNOWN_STATE"]
    df = spark.createDataFrame([(s,) for s in states] + [(None,)], "state string")
    got = {r["state"]: r["s"] for r in df.select("state", L.hive_status(F.col("state")).alias("s")).collect()}
    assert [got[s] for s in states] == ["RUNNING"] * 3 + ["SUCCEEDED", "KILLED"] + ["FAILED"] * 3
    assert got[None] == "FAILED"


def test_lookups_report_unknown_keys(spark, rows):
    ids = spark.createDataFrame([("t1",), ("zz",), ("t6",)], "otid string")
    assert rows(K.task_status(tasks(spark), ids)) == [("t1", "RUNNING", 1), ("t6", None, 6), ("zz", "NOT_EXIST", None)]
    keys = spark.createDataFrame([("j1", "MR.a"), ("j9", "x"), ("j1", "MR.a")], "jobinstanceid string, opid string")
    assert rows(K.task_by_instance(tasks(spark), keys)) == [("j1", "MR.a", "t2"), ("j9", "x", "NOT_EXIST")]


def test_unfinished_counts_null_and_killed(spark, rows):
    apps = spark.createDataFrame(
        [("t1", s, i) for i, s in enumerate(["SUCCEEDED", "FAILED", "KILLED", None, "RUNNING"])],
        "otid string, status string, sequence int")
    ids = tasks(spark).select("otid")
    assert [r[1] for r in rows(K.unfinished_apps(apps, ids), "sequence", "status")] == ["KILLED", None, "RUNNING"]
    assert [r[1] for r in rows(K.unfinished_apps(apps, ids, strict=True), "sequence", "status")] == [None, "RUNNING"]


def test_kill_plan(spark, rows):
    apps = spark.createDataFrame(
        [("t1", 1, "a1", "SUCCEEDED"), ("t1", 2, "a2", "RUNNING"), ("t1", 3, "a3", None)],
        "otid string, sequence int, appid string, status string")
    ids = spark.createDataFrame([("t1",), ("t1",), ("t2",), ("t3",), ("t4",), ("t6",), ("zz",)], "otid string")
    assert rows(L.kill_plan(ids, tasks(spark), apps), "otid", "action", "appid") == sorted([
        ("t1", "KILL_APPLICATION", "a2"), ("t1", "KILL_APPLICATION", "a3"), ("t2", "KILL_APPLICATION", None),
        ("t3", "HIVE_CANCEL", None), ("t4", "ALREADY_FINISHED", None), ("t6", "ALREADY_FINISHED", None),
        ("zz", "NOT_EXIST", None)], key=repr)


def test_kill_outcome_names_the_first_failure(spark, rows):
    apps = spark.createDataFrame(
        [("t1", 1, "a1", True), ("t1", 2, "a2", False), ("t1", 3, "a3", False), ("t2", 1, "b1", True)],
        "otid string, sequence int, appid string, killed boolean")
    assert rows(L.kill_outcome(apps)) == [
        ("t1", False, "a2", "RUNNING", C.KILL_REFUSED % "a2"), ("t2", True, None, "KILLED", "")]


def test_log_requests(spark, rows):
    keys = spark.createDataFrame([("j1", "MR.a"), ("j3", "HV.b"), ("j9", "x")], "jobinstanceid string, opid string")
    apps = spark.createDataFrame([("t2",), ("t2",)], "otid string")
    assert rows(L.log_requests(keys, tasks(spark), apps), "otid", "n_apps", "message") == sorted([
        ("t2", 2, ""), ("t3", 0, C.NO_APPLICATION_ID), ("NOT_EXIST", 0, C.INSTANCE_UNKNOWN % ("x", "j9"))])


def test_results_and_kill_override(spark, rows):
    t = spark.createDataFrame([("t1", "/x"), ("t2", "/y/"), ("t3", "/z"), ("t4", "/w")], "otid string, base_path string")
    out = spark.createDataFrame([("t1", "<o/>"), ("t4", "<o4/>")], "otid string, stdout string")
    err = spark.createDataFrame([("t1", "<e/>"), ("t2", "<e2/>")], "otid string, stderr string")
    results = L.resolve_result(t, out, err)
    assert rows(results) == [
        ("t1", "stdout", "<o/>"), ("t2", "stderr", "<e2/>"),
        ("t3", "error", "/z/stdout.xml and /z/stderr.xml not exist"), ("t4", "stdout", "<o4/>")]
    assert ("t4", "error", "the optask is killed") in rows(L.apply_kill(results, tasks(spark)))


def test_start_tasks(spark, rows):
    req = spark.createDataFrame(
        [("MR.a", "p", "j", "u", None, dt.datetime(2020, 1, 2, 3, 4, 5, 678000), "sync")],
        "opid string, processid string, jobinstanceid string, username string, queuename string, "
        "submit_ts timestamp_ntz, submission string")
    got = L.start_tasks(req).first()
    assert got["otid"] == "MR.a2020-01-02_03-04-05-678"
    assert (got["queuename"], got["status"]) == ("default", "RUNNING")


def test_updates_and_deletes(spark, rows):
    table = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "k string, status string, n int")
    updates = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", None, 1), ("zz", "w", 1)], "k string, status string, at int")
    once = K.apply_updates(table, updates, "k", ["status"], ["at"])
    assert rows(once) == sorted([("a", "q", 1), ("b", None, 2), ("c", "z", 3)], key=repr)
    assert rows(K.apply_updates(once, updates, "k", ["status"], ["at"])) == rows(once)
    assert rows(K.apply_deletes(table, updates, "k")) == [("c", "z", 3)]


def test_split_existing_covers_the_batch(spark, rows):
    batch = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    registry = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    known, missing = K.split_existing(batch, registry, "k")
    assert rows(known) == [("a",), ("a",)]
    assert sorted(rows(known) + rows(missing), key=repr) == rows(batch)
    assert rows(K.mark_existing(batch, registry, "k")) == sorted(
        [("a", True), ("a", True), ("b", False), (None, False)], key=repr)


def test_the_last_hive_instance_counts(spark, rows):
    tasks = spark.createDataFrame([("1", "HV.a"), ("2", "HV.a"), ("3", "MR.a")], "otid string, opid string")
    instances = spark.createDataFrame(
        [("1", "FINISHED_STATE", 2), ("1", "RUNNING_STATE", 1), ("1", "ERROR_STATE", None), ("3", "RUNNING_STATE", 1)],
        "otid string, state string, submittime int")
    assert rows(L.hive_task_status(tasks, instances), "otid", "status") == [("1", "SUCCEEDED"), ("2", "FAILED")]


def test_kill_by_instance(spark, rows):
    keys = spark.createDataFrame(
        [("j1", "MR.a"), ("j3", "HV.b"), ("j4", "GM.c"), ("j9", "MR.a"), (None, "MR.a")], "jobinstanceid string, opid string")
    apps = spark.createDataFrame(
        [("t1", 1, app(1), "RUNNING"), ("t2", 1, app(2), "RUNNING"), ("t2", 2, app(3), "SUCCEEDED"), ("t2", 3, app(4), None)],
        "otid string, sequence int, appid string, status string")
    found = L.kill_by_instance(keys, tasks(spark), apps)
    # t2 is the last task of (j1, MR.a).
    assert rows(found, "jobinstanceid", "opid", "otid", "action", "appid") == sorted([
        ("j1", "MR.a", "t2", C.KILL_APPLICATION, app(2)), ("j1", "MR.a", "t2", C.KILL_APPLICATION, app(4)),
        ("j3", "HV.b", "t3", C.HIVE_CANCEL, None), ("j4", "GM.c", "t4", C.ALREADY_FINISHED, None),
        ("j9", "MR.a", None, C.NOT_EXIST, None), (None, "MR.a", None, C.NOT_EXIST, None)], key=repr)
    told = {r["jobinstanceid"]: r["message"] for r in found.filter("otid is null").collect()}
    assert told["j9"] == "the opTask(MR.a) of jobinstanceid( j9)  is not submitted to the yarn"
