"""Request rules: every error, its precedence, and documents with several errors."""

from pyspark.sql import functions as F

from jobtrail import constants as C
from jobtrail.operators import packages as PK
from jobtrail.plans import registration as R
from jobtrail.plans import validation as V
from jobtrail.plans.registry import QUERIES, Tables
from jobtrail.sources import documents as D


def docs(spark, *xml):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "i int, xml string")


def prop(name, value):
    return f"<property name='{name}' value='{value}'/>" if value is not None else f"<property name='{name}'/>"


def task(instance="<jobinstanceid>j</jobinstanceid>", *props):
    return f"<r>{instance}<context>{''.join(props)}</context></r>"


FULL = [prop("userName", "u"), prop("processId", "p"), prop("tempHdfsBasePath", "/t")]


def judge_task(spark, xml):
    return V.validate_tasks(D.parse_requests(docs(spark, xml), "task")).first()


def test_task_defaults_and_values(spark):
    row = judge_task(spark, task("<jobinstanceid>j 1</jobinstanceid>", *FULL))
    assert (row["error"], row["queuename"], row["jobinstanceid"], row["base_path"]) == ("", "default", "j 1", "/t")
    row = judge_task(spark, task("<jobinstanceid>a</jobinstanceid><jobinstanceid>b</jobinstanceid>", *FULL,
                                 prop("queueName", "q1"), prop("queueName", "q2")))
    assert (row["jobinstanceid"], row["queuename"]) == ("a", "q2")


def test_task_rules_one_by_one(spark):
    long = "x" * 129
    cases = {
        task("", *FULL): C.NO_JOB_INSTANCE,
        task("<jobinstanceid/>", *FULL): "",
        task(f"<jobinstanceid>{long}</jobinstanceid>", *FULL): "jobInstanceId长度不能大于128",
        "<r><jobinstanceid>j</jobinstanceid></r>": C.NO_CONTEXT,
        "<r><jobinstanceid>j</jobinstanceid><context/></r>": C.NO_BASE_PATH,
        task("<jobinstanceid>j</jobinstanceid>", *FULL, prop("queueName", long)): "queueName长度不能大于128",
        task("<jobinstanceid>j</jobinstanceid>", *FULL, prop("queueName", "")): "",
        task("<jobinstanceid>j</jobinstanceid>", prop("userName", ""), *FULL[1:]): "the property userName is null",
        task("<jobinstanceid>j</jobinstanceid>", prop("userName", long), *FULL[1:]): "userName长度不能大于128",
        task("<jobinstanceid>j</jobinstanceid>", FULL[0], prop("processId", long), FULL[2]): "processId长度不能大于128",
        task("<jobinstanceid>j</jobinstanceid>", FULL[0], FULL[1], prop("tempHdfsBasePath", "")): "the property tempHdfsBasePath is null",
        task("<jobinstanceid>j</jobinstanceid>", FULL[0], FULL[1], prop("tempHdfsBasePath", long)): "",
        task("<jobinstanceid>j</jobinstanceid>", *FULL[1:]): C.NO_USER,
        task("<jobinstanceid>j</jobinstanceid>", FULL[0], FULL[2]): C.NO_PROCESS,
        "<r><context>": C.MALFORMED,
    }
    got = V.validate_tasks(D.parse_requests(docs(spark, *cases), "task")).orderBy("i").collect()
    assert [r["error"] for r in got] == list(cases.values())


def test_task_last_error_wins_and_all_are_listed(spark):
    long = "x" * 129
    row = judge_task(spark, task(f"<jobinstanceid>{long}</jobinstanceid>", prop("processId", ""), prop("userName", ""),
                                 prop("tempHdfsBasePath", "")))
    assert row["errors"] == ["jobInstanceId长度不能大于128", "the property processId is null",
                             "the property userName is null", "the property tempHdfsBasePath is null"]
    assert row["error"] == row["errors"][-1]
    row = judge_task(spark, f"<r><jobinstanceid>{long}</jobinstanceid></r>")
    assert row["errors"] == ["jobInstanceId长度不能大于128", C.NO_CONTEXT]
    row = judge_task(spark, "<r><context/></r>")
    assert row["errors"] == [C.NO_JOB_INSTANCE, C.NO_USER, C.NO_PROCESS, C.NO_BASE_PATH]


def operator(*props):
    return f"<operator>{''.join(props)}</operator>"


def judge_operators(spark, *xml, **kw):
    paths = spark.createDataFrame([("/ops/a.zip",)], "path string")
    parsed = D.parse_requests(docs(spark, *xml), "operator")
    return V.validate_operators(parsed, paths, **kw).orderBy("i").collect()


def test_operator_rules_first_in_document_order(spark):
    zip_ok, zip_no, zip_empty = prop("opjarpath", "/ops/a.zip"), prop("opjarpath", "/ops/b.zip"), prop("opjarpath", "")
    cases = [
        (operator(prop("opid", "SK.a"), zip_ok), ""),
        (operator(prop("opid", ""), zip_ok), C.OPID_NULL),
        (operator(prop("opid", "SK a"), zip_ok), C.OPID_SPACE),
        (operator(prop("opid", "SKa"), zip_ok), C.OPID_NO_DOT),
        (operator(prop("opid", "XX.a"), zip_ok), C.OPID_ENGINE),
        (operator(prop("opid", "SK.a"), zip_empty), C.OPJARPATH_NULL),
        (operator(prop("opid", "SK.a"), zip_no), "the hdfs zip(/ops/b.zip) is not exist"),
        (operator(prop("opid", "XX.a"), zip_no), C.OPID_ENGINE),
        (operator(zip_no, prop("opid", "XX.a")), "the hdfs zip(/ops/b.zip) is not exist"),
        (operator(zip_ok), C.OPID_NULL),
        (operator(prop("opid", "SK.a")), C.OPJARPATH_NULL),
        (operator(), C.OPID_NULL),
        ("<operator>", C.MALFORMED),
    ]
    assert [r["error"] for r in judge_operators(spark, *[c[0] for c in cases])] == [c[1] for c in cases]


def test_operator_lengths_first_wins_and_missing_fields_pass(spark):
    base = [prop("opid", "SK." + "a" * 62), prop("opjarpath", "/ops/a.zip")]
    rows = judge_operators(
        spark,
        operator(*base, prop("version", "v" * 65), prop("descriptor", "d" * 1025)),
        operator(prop("opid", "SK.a"), base[1], prop("descriptor", "d" * 1025), prop("provider", "p" * 65)),
        operator(prop("opid", "SK.a"), base[1], prop("instruction", "d" * 1025)),
        operator(prop("opid", "SK.a"), base[1], prop("descriptor", "d" * 1024)),
    )
    assert [r["error_length"] for r in rows] == [
        "opid长度不能大于64", "provider长度不能大于64", "instruction长度不能大于1024", ""]
    assert rows[0]["errors_length"] == ["opid长度不能大于64", "version长度不能大于64", "descriptor长度不能大于1024"]


def udf(**fields):
    inner = "".join(f"<{k}>{v}</{k}>" for k, v in fields.items())
    return f"<r><udfdescriptor>{inner}</udfdescriptor></r>"


GOOD = {"udfname": "Fn", "classname": "c", "jarname": "j", "descriptor": "d", "author": "a"}


def judge_udfs(spark, *xml):
    return V.validate_udfs(D.parse_requests(docs(spark, *xml), "udf"))


def test_udf_rules(spark):
    without = lambda *names: udf(**{k: v for k, v in GOOD.items() if k not in names})
    got = judge_udfs(
        spark, udf(**GOOD), without("udfname"), without("udfname", "jarname"), without("descriptor", "author"),
        udf(**{**GOOD, "jarname": "j" * 65, "descriptor": "d" * 1025}), "<r/>").orderBy("i").collect()
    assert [r["error"] for r in got] == ["", "udfname is null", "jarname is null", "author is null", "", "author is null"]
    assert got[4]["error_length"] == "jarname长度不能大于64"


def test_udf_update_quota_and_queue_rules(spark):
    updates = V.validate_udf_updates(D.parse_requests(docs(
        spark, "<r><descriptor>d</descriptor></r>", "<r/>", f"<r><descriptor>{'d' * 1025}</descriptor></r>",
        "<r><descriptor/></r>"), "udf_update")).orderBy("i").collect()
    assert [r["error"] for r in updates] == ["", "descriptor is null", "descriptor长度不能大于1024", ""]
    quota = V.validate_quotas(D.parse_requests(docs(spark, *[
        f"<r><quota>{q}</quota></r>" for q in ("50GB", "51GB", "xGB", "", "9999999999999GB")], "<r/>"), "quota")).orderBy("i").collect()
    assert [r["error"] for r in quota] == [
        "", C.QUOTA_TOO_LARGE, C.QUOTA_NOT_NUMBER, C.QUOTA_NOT_NUMBER, C.QUOTA_TOO_LARGE, C.QUOTA_NULL]
    assert quota[0]["quota_bytes"] == C.MAX_QUOTA_BYTES
    queue = V.validate_queues(D.parse_requests(docs(
        spark, "<q><name>a</name><calcresource><memtotal>5</memtotal></calcresource></q>",
        "<q><calcresource><memtotal>5</memtotal><userlimitfactor>2.0</userlimitfactor></calcresource></q>",
        "<q><name>a</name></q>", "<q/>"), "queue")).orderBy("i").collect()
    assert [(r["error"], r["userlimitfactor"]) for r in queue] == [
        ("", "1.0"), (C.QUEUE_NAME_MISSING, "2.0"), (C.MEMTOTAL_MISSING, "1.0"), (C.MEMTOTAL_MISSING, "1.0")]


def package(opid, *extra):
    return [(opid, f"{opid}/{e}") for e in ("run.sh", f"{opid}.jar", "description.xml", "ui.xml", *extra)]


def test_packages(spark, rows):
    entries = spark.createDataFrame(
        package("SK.a") + package("GM.a", "lib/Dshell2.5.0V2.jar") + package("GM.b") + [("MR.a", "MR.a/run.sh")],
        "opid string, entry string")
    ops = spark.createDataFrame([(o,) for o in ("SK.a", "GM.a", "GM.b", "MR.a", "HV.none")], "opid string")
    assert rows(PK.package_check(entries, ops), "opid", "complete", "missing") == sorted([
        ("GM.a", True, []), ("GM.b", True, []), ("SK.a", True, []),
        ("HV.none", False, ["run.sh", "<opid>.jar", "description.xml", "ui.xml"]),
        ("MR.a", False, ["<opid>.jar", "description.xml", "ui.xml"])])
    script = spark.createDataFrame(
        [("GM.a", " # Dshell2.5.0V2.jar"), ("GM.a", "hadoop jar Dshell2.5.0V2.jar x"), ("GM.b", "#Dshell2.5.0V2.jar")],
        "opid string, line string")
    assert rows(PK.submit_jar_check(entries, script, ops)) == [("GM.a", True, True, True), ("GM.b", False, False, False)]
    assert rows(PK.script_uses(script, C.SUBMIT_JAR)) == [("GM.a", True), ("GM.b", False)]


def test_stale_packages(spark, rows):
    local = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", None)], "opid string, checksum string")
    published = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")], "opid string, checksum string")
    assert rows(PK.stale_packages(local, published), "opid", "stale") == [
        ("a", False), ("b", True), ("c", True), ("d", True)]


def test_operator_registration_order_of_checks_and_repeats(spark):
    zip_ok = prop("opjarpath", "/ops/a.zip")
    xml = [
        operator(prop("opid", "SK.a"), zip_ok, prop("version", "v" * 65)),  # too long: refused
        operator(prop("opid", "SK.a"), zip_ok),                             # accepted
        operator(prop("opid", "SK.a"), zip_ok),                             # exists by now
        operator(prop("opid", "SK.old"), zip_ok),                           # registered before
        operator(prop("opid", "MR.part"), zip_ok),                          # incomplete
        operator(prop("opid", "GM.a"), zip_ok),                             # no submit jar
        operator(prop("opid", ""), zip_ok),
    ]
    entries = spark.createDataFrame(package("SK.a") + package("GM.a") + package("SK.old"), "opid string, entry string")
    script = spark.createDataFrame([("GM.a", "echo")], "opid string, line string")
    registry = spark.createDataFrame([("SK.old",)], "opid string")
    paths = spark.createDataFrame([("/ops/a.zip",)], "path string")
    parsed = V.validate_operators(D.parse_requests(docs(spark, *xml), "operator"), paths)
    judged = R.register_operators(parsed, registry, entries, script, "i")
    assert [r["reason"] for r in judged.orderBy("i").collect()] == [
        "version长度不能大于64", "", "the opid 'SK.a' is exist", "the opid 'SK.old' is exist",
        "The ZIP file of 'MR.part' in HDFS  is not completed .", C.SUBMIT_JAR_REQUIRED, C.OPID_NULL]
    assert R.accepted(judged).count() == 1 and R.rejected(judged).count() == 6


def test_operator_update_and_delete(spark, rows):
    xml = [operator(prop("opjarpath", "/ops/a.zip"), prop("version", "v2")), operator(prop("version", "v3")),
           operator(prop("opjarpath", "/ops/a.zip"))]
    df = docs(spark, *xml).withColumn("opid", F.element_at(F.array(*[F.lit(o) for o in ("SK.a", "SK.a", "zz")]), F.col("i") + 1))
    paths = spark.createDataFrame([("/ops/a.zip",)], "path string")
    registry = spark.createDataFrame([("SK.a", "v1"), ("SK.b", "v1")], "opid string, version string")
    entries = spark.createDataFrame(package("SK.a"), "opid string, entry string")
    script = spark.createDataFrame([], "opid string, line string")
    judged = R.judge_operator_updates(
        V.validate_operators(D.parse_requests(df, "operator"), paths, update=True), registry, entries, script)
    assert [r["reason"] for r in judged.orderBy("i").collect()] == ["", C.OPJARPATH_NULL, "the opid 'zz' is not exist"]
    assert rows(R.update_operators(registry, judged, ["version"], "i")) == [("SK.a", "v2"), ("SK.b", "v1")]
    gone = R.judge_deletes(df.select("i", "opid"), registry, "opid", C.OPID_UNKNOWN)
    assert rows(R.delete_registered(registry, gone, "opid")) == [("SK.b", "v1")]


def test_udf_registration(spark):
    names = ["Fn", "SUM", "known", "Meta", "fn", "ok", "OK"]
    xml = [udf(**{**GOOD, "udfname": n}) for n in names]
    xml[5] = udf(**{**GOOD, "udfname": "ok", "author": "a" * 65})
    registry = spark.createDataFrame([("Known",)], "udfname string")
    meta = spark.createDataFrame([("meta",)], "func_name string")
    judged = R.register_udfs(judge_udfs(spark, *xml), registry, meta, "i").orderBy("i").collect()
    assert [r["reason"] for r in judged] == [
        "", C.UDF_SYSTEM % "sum", C.UDF_EXISTS % "known", C.UDF_IN_METASTORE % "meta", C.UDF_EXISTS % "fn",
        "author长度不能大于64", ""]


def test_reserved_names():
    assert len(C.SYSTEM_FUNCTIONS) == len(set(C.SYSTEM_FUNCTIONS)) == 196


def test_documents_to_rows(spark, rows):
    xml = "<configuration><property><name>a</name><value>1</value></property><property><name>b</name></property></configuration>"
    assert rows(D.read_properties(docs(spark, xml, "<configuration/>"))) == sorted([(0, 0, "a", "1"), (0, 1, "b", None)], key=repr)
    json = ('{"scheduler":{"schedulerInfo":{"queues":{"queue":[{"queueName":"q","capacity":"20.0","maxCapacity":"60.0",'
            '"userLimitFactor":"1.5","maxApplications":"7","numActiveApplications":"1","numPendingApplications":"2",'
            '"resourcesUsed":{"memory":512,"vCores":3}},{"queueName":"r"}]}}}}')
    df = spark.createDataFrame([(json,), ("{bad",)], "json string")
    assert rows(D.read_scheduler(df)) == sorted([
        (0, "q", 20.0, 60.0, 1.5, 7, 1, 2, 512.0, 3.0), (1, "r", None, None, None, None, None, None, None, None)], key=repr)
    roles = '{"items":[{"name":"n1","type":"NODEMANAGER","haStatus":null,"roleConfigGroupRef":{"roleConfigGroupName":"g"}}]}'
    df = spark.createDataFrame([(roles,)], "json string")
    assert rows(D.read_roles(df)) == [(0, "n1", "NODEMANAGER", None, "g")]
    groups = ('{"items":[{"name":"g","roleType":"NODEMANAGER","config":{"items":['
              '{"name":"yarn_nodemanager_resource_memory_mb","value":"1024"},'
              '{"name":"yarn_nodemanager_resource_memory_mb","value":"9"}]}}]}')
    assert rows(D.read_role_groups(spark.createDataFrame([(groups,)], "json string"))) == [("g", "NODEMANAGER", 1024, 0)]


def test_updates_with_equal_request_numbers(spark, rows, tmp_path):
    """Resubmissions are numbered from 1000000 on and meet the numbers of other operators there."""
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").filter("p_partkey < 60")
    parts.unionByName(parts.withColumn("p_partkey", F.col("p_partkey") + 1000000)).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = Tables(spark, str(tmp_path)).operator_doc_v
    assert docs.count() > docs.select("req_id").distinct().count()
    got = QUERIES["i9_judge_operator_updates"](spark, str(tmp_path))
    assert rows(got, "req_id", "opid") == rows(docs.select("req_id", F.coalesce("opid", F.lit("")).alias("opid")))
