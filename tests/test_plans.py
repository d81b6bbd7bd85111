"""Plans that have to stay as they are for large inputs."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobtrail.fixtures import CHEAPER, VIEWS
from jobtrail.operators import ledger as L
from jobtrail.operators import storage as S
from jobtrail.operators.ordered import sequence_rows
from jobtrail.plans.registry import Tables

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
PYTHON = (r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|BatchEvalPythonUDTF|ArrowEvalPythonUDTF"
          r"|MapInArrow|FlatMapGroupsInArrow")
#: Text operators of free style; op2 and op3 are built from expressions only.
FREE = re.compile(r"op(1|4|5|6|7|8|9|10|11|12|13)_|pipeline$")
#: Queries that write their files first; the query test covers them.
WRITERS = ("a1_read_task_logs", "a2_read_container_logs", "c5_task_logs", "a11_walk_files", "d4_storage_of_listing", "k1_expired_of_listing",
           "c8_merge_in_place")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> int:
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan))


def source_text() -> dict[str, str]:
    """Sources of the library; the optional text operators have a test of their own."""
    root = pathlib.Path(entry.__file__).parent / "jobtrail"
    return {str(p): p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts}


def test_nothing_is_broadcast_by_force_or_collected():
    for path, text in source_text().items():
        assert not re.search(r"broadcast\(|\.collect\(\)|toPandas|localCheckpoint|crossJoin|\.rdd\b|\.cache\(\)", text), path


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(("m2_", "l")) and not FREE.match(n)])
def test_no_python_in_plans(spark, name):
    if name in WRITERS:
        pytest.skip("writes files first; covered by the query test")
    assert not re.search(PYTHON, plan_of(QUERIES[name](spark, SF)))


def test_retention_filter_reaches_the_scan(spark):
    files = Tables(spark, SF).events.withColumnRenamed("ts", "mtime")
    old, kept = S.split_expired(files, "2024-01-25 12:00:00")
    assert re.search(r"PushedFilters: \[.*LessThan\(ts,", plan_of(old))
    assert re.search(r"PushedFilters: \[Or\(GreaterThanOrEqual\(ts,", plan_of(kept))


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<text:string>" in plan_of(QUERIES["f12_ngrams"](spark, SF))
    # Path and size come from three columns; times and properties stay unread.
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan_of(
        QUERIES["d4_storage_usage"](spark, SF))


def test_numbering_and_neighbours_share_one_shuffle(spark):
    apps = Tables(spark, SF).app_v
    plan = plan_of(sequence_rows(apps, ["otid"], ["start_ts", "tie1", "tie2", "tie3"], following={"nxt": "start_ts"}))
    assert exchanges(plan) == 1 and plan.count("Window [") == 1


def test_flagship_shuffles_are_bounded(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["h1_ledger_tasks"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert exchanges(plan) <= 8
    assert "Window [" not in plan  # the status comes from map-side aggregates


def test_operator_requests_are_judged_from_few_reads(spark):
    plan = QUERIES["i9_judge_operator_updates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and plan.count("Relation [") <= 12


def test_status_aggregates_before_it_joins(spark):
    t = Tables(spark, SF)
    plan = plan_of(L.final_status(t.optask_v, t.app_v, ["start_ts"]))
    assert "partial_max_by" in plan


def test_validation_needs_no_shuffle(spark):
    for name in ("i1_validate_tasks", "i5_validate_quotas", "i6_validate_queues"):
        assert exchanges(plan_of(QUERIES[name](spark, SF))) == 0


def test_hot_lookup_counts_distinct_rows_once(spark):
    big = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("n"))
    registry = spark.createDataFrame([("hot",)], "k string")
    from jobtrail.operators.keys import mark_existing
    assert mark_existing(big, registry, "k").filter("exists").count() == 1000


def test_package_entries_are_one_row_a_part_before_the_join(spark):
    t = Tables(spark, SF)
    plan = t.package_entry_v._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner.*Aggregate \[l_partkey.*parquet", plan, re.S)
    odd = t.lineitem.limit(60).withColumn("l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, 0).cast(t.lineitem.schema["l_linenumber"].dataType))
    lines = t.lineitem.unionByName(odd.withColumn("l_quantity", F.lit(1).cast(t.lineitem.schema["l_quantity"].dataType)))
    forms = [spark.sql(sql["package_entry_v"], lineitem=lines, operator_request_v=t.operator_request_v) for sql in (VIEWS, CHEAPER)]
    assert forms[0].count() > 0 and forms[0].exceptAll(forms[1]).count() == forms[1].exceptAll(forms[0]).count() == 0
    assert forms[0].dtypes == forms[1].dtypes


def test_missing_entries_shuffle_no_entry_texts(spark):
    plan = QUERIES["g3_missing_entries"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and not re.search(r"Aggregate \[[^\]]*entry", plan)
