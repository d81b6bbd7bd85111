from pyspark.sql import functions as F

from jobtrail.operators import capacity as CP
from jobtrail.operators import storage as S

ROLES = "pos int, name string, type string, ha_status string, group_name string, cluster string"


def roles(spark):
    return spark.createDataFrame([
        (0, "m0", "RESOURCEMANAGER", "STANDBY", "m", "a"), (1, "m1", "RESOURCEMANAGER", "ACTIVE", "m", "a"),
        (2, "m2", "RESOURCEMANAGER", "UNKNOWN", "m", "a"), (0, "x0", "RESOURCEMANAGER", "UNKNOWN", "m", "b"),
        (1, "x1", "RESOURCEMANAGER", "ACTIVE", "m", "b"), (0, "y0", "RESOURCEMANAGER", "STANDBY", "m", "c"),
        (3, "n1", "NODEMANAGER", None, "g1", "a"), (4, "n2", "NODEMANAGER", None, "g1", "a"),
        (5, "n3", "NODEMANAGER", None, "g2", "a"), (6, "n4", "NODEMANAGER", None, "unknown", "a"),
    ], ROLES)


def groups(spark):
    return spark.createDataFrame([("g1", 1000, 4), ("g2", 500, 2), ("empty", 9999, 99)],
                                 "group_name string, memory_mb int, vcores int")


def test_capacity_ignores_empty_groups(spark, rows):
    assert rows(CP.role_counts(roles(spark))) == [("g1", 2), ("g2", 1), ("unknown", 1)]
    assert rows(CP.cluster_capacity(roles(spark), groups(spark))) == [(2500, 10)]
    assert rows(CP.cluster_capacity(roles(spark).filter("false"), groups(spark))) == [(0, 0)]


def test_active_master_stops_at_the_first_decisive_state(spark, rows):
    assert rows(CP.active_master(roles(spark), "cluster")) == [("a", "m1"), ("b", "UNKNOWN")]


def test_share_rounds_half_up(spark):
    df = spark.createDataFrame([(5, 1000), (15, 1000), (4, 1000), (1000, 1000)], "r int, t int")
    got = [r[0] for r in df.select(CP.capacity_share(F.col("r"), F.col("t"))).collect()]
    assert got == [1.0, 2.0, 0.0, 100.0]


def test_queue_report(spark):
    queues = spark.createDataFrame(
        [("q", 20.0, 60.0, 1.0, 7, 1, 2, 100.0, 1.0), ("r", 20.0, 60.0, 4.0, 7, 1, 2, 100.0, 1.0)],
        "queue_name string, capacity double, max_capacity double, user_limit_factor double, max_applications bigint, "
        "active_applications bigint, pending_applications bigint, mem_used double, vcores_used double")
    apps = spark.createDataFrame([("q", "FINISHED"), ("q", "RUNNING"), ("z", "FINISHED")], "queue_name string, state string")
    got = {r["name"]: r for r in CP.queue_report(queues, roles(spark), groups(spark), apps).collect()}
    assert (got["q"]["memtotal"], got["q"]["memavail"], got["q"]["cputotal"], got["q"]["numfinishedapps"]) == (500.0, 400.0, 2.0, 1)
    # The factor lifts r over its maximum: memory becomes the whole cluster, vcores do not.
    assert (got["r"]["memtotal"], got["r"]["cputotal"], got["r"]["numfinishedapps"]) == (2500.0, 8.0, 0)


def test_admission(spark):
    properties = spark.createDataFrame([
        (0, "yarn.scheduler.capacity.root.default.capacity", "100"), (1, "yarn.scheduler.capacity.root.q.capacity", "9"),
        (2, "yarn.scheduler.capacity.root.default.capacity", "30"), (3, "yarn.scheduler.capacity.root.q.capacity", "10"),
        (4, "yarn.scheduler.capacity.root.q.state", "RUNNING"), (5, "yarn.scheduler.capacity.root.queues", "default,q")],
        "pos int, name string, value string")
    requests = spark.createDataFrame(
        [("n", "300", "1.0"), ("q", "400", "2.0"), ("q", "401", "9.0"), ("new", "900", "1.0")],
        "queue_name string, memtotal string, userlimitfactor string")
    create = CP.admission(requests, properties, F.lit(1000)).collect()
    assert [(r["share"], r["default_left"], r["admitted"], r["max_capacity"]) for r in create] == [
        (30.0, 0.0, True, 30.0), (40.0, -10.0, False, 80.0), (40.0, -10.0, False, 100.0), (90.0, -60.0, False, 90.0)]
    update = {(r["queue_name"], r["memtotal"]): (r["default_left"], r["admitted"])
              for r in CP.admission(requests, properties, F.lit(1000), update=True).collect()}
    assert update == {("n", "300"): (30.0, True), ("q", "400"): (0.0, True), ("q", "401"): (0.0, True), ("new", "900"): (30.0, True)}


def test_drift(spark, rows):
    a = spark.createDataFrame([("q", 1.0, 2.0), ("r", 1.0, 1.0)], "queue_name string, capacity double, user_limit_factor double")
    b = spark.createDataFrame([("q", 1.0, 3.0), ("r", 1.0, 1.0)], "queue_name string, capacity double, user_limit_factor double")
    assert rows(CP.queue_drift(a, b)) == [("q", "user_limit_factor", 2.0, 3.0)]


def test_usage_and_retention(spark, rows):
    files = spark.createDataFrame(
        [("a", "/a/1", 60, "2024-01-01 00:00:00"), ("a", "/a/2", 50, "2024-01-05 00:00:00"), ("b", "/b/1", 5, None)],
        "group_name string, path string, size_bytes bigint, m string").withColumn("mtime", F.col("m").cast("timestamp_ntz"))
    quotas = spark.createDataFrame([("a", 100)], "group_name string, quota_bytes bigint")
    assert rows(S.storage_usage(files, quotas), "group_name", "used_bytes", "n_files", "over_quota") == [
        ("a", 110, 2, True), ("b", 5, 1, False)]
    old, kept = S.split_expired(files, "2024-01-10 00:00:00")
    # Exactly five days old is kept; a file without a time is kept.
    assert rows(old, "path") == [("/a/1",)]
    assert rows(kept, "path") == [("/a/2",), ("/b/1",)]


def test_group_is_the_first_directory_below_the_root(spark, rows):
    files = spark.createDataFrame(
        [("hdfs://n/user/department/a/x/y",), ("/user/department/b/z",), ("/tmp/other",)], "path string")
    assert rows(S.with_group(files, "/user/department/"), "path", "group_name") == [
        ("/user/department/b/z", "b"), ("hdfs://n/user/department/a/x/y", "a")]


def test_storage_groups_are_anchored_and_complete(spark):
    paths = ["/user/department/x/1", "hdfs://h:1/user/department/x/2", "/backup/user/department/x/1", "/user/department/readme.txt"]
    files = spark.createDataFrame([(p, 5) for p in paths], "path string, size_bytes long")
    quotas = spark.createDataFrame([("x", 9), ("idle", 3)], "group_name string, quota_bytes long")
    found = S.storage_usage(S.with_group(files, "/user/department/"), quotas).collect()
    assert sorted((r["group_name"], r["used_bytes"], r["n_files"], r["quota_bytes"], r["over_quota"]) for r in found) == [
        ("idle", 0, 0, 3, False), ("x", 10, 2, 9, True)]
