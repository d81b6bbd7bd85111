"""Sources and sinks, each fed from files that Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtrail.fixtures import append_to_files
from jobtrail.functions.parsing import stamp_to_timestamp, timestamp_to_stamp
from jobtrail.operators import storage
from jobtrail.operators.keys import task_by_instance
from jobtrail.operators.ledger import build_ledger, task_logs
from jobtrail.plans.ledger_queries import APP_ORDER, ASKED, NUMBERED, WANTED, asked, numbered, wanted
from jobtrail.plans.registry import Tables, query
from jobtrail.session import scratch_path
from jobtrail.sources import files, logs, sinks, tables
from jobtrail.sources.buckets import BucketLedger

EVENT_LINES = """
  event_lines as (select 'SK.' || event_type || strftime(ts, '%Y-%m-%d') || '_00-00-00-000' as otid,
      case when event_type = 'error' then 'stderr' else 'stdout' end as stream,
      strftime(ts, '%Y-%m-%d') as log_date, event_id, 'event ' || event_id || ' ' || props as line from events)"""


@query("a1_read_task_logs", "select otid, stream, log_date, line from event_lines", extra=EVENT_LINES)
def a1(t: Tables):
    path = scratch_path(t.spark, "task-logs")
    lines = t.events.select(
        F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream"),
        F.date_format("ts", "yyyy-MM-dd").alias("log_date"),
        F.concat(F.lit("SK."), "event_type", F.lit("_00-00-00-000")).alias("task"),
        F.concat_ws(" ", F.lit("event"), "event_id", "props").alias("value"),
    )
    lines.hint("rebalance", "log_date").write.partitionBy("stream", "log_date", "task").text(path)
    return logs.read_task_logs(t.spark, path).select("otid", "stream", "log_date", "line")


@query("h1_ledger_from_files", """
, subs as (select otid, event_id, ts, 'application_1700000000000_' || lpad(cast(event_id as varchar), 7, '0') as appid,
             case when props like '%7%' then 'FAILED' else 'SUCCEEDED' end as status
           from event_lines l join events e using (event_id)
           where l.stream = 'stderr' or e.event_type in ('click', 'purchase')),
  numbered as (select *, row_number() over (partition by otid order by epoch_us(ts) // 1000, event_id) as n,
             count(*) over (partition by otid) as n_apps from subs),
  tasks as (select distinct otid from event_lines)
select t.otid, coalesce(n.n_apps, 0) as n_apps, coalesce(n.appid, '') as last_appid, coalesce(n.status, 'FINISHED') as status
from tasks t left join numbered n on n.otid = t.otid and n.n = n.n_apps""", extra=EVENT_LINES)
def h1_files(t):
    """From files to the final status: every event is a submission in the log of its day and kind."""
    path = scratch_path(t.spark, "task-logs")
    appid = F.concat(F.lit("application_1700000000000_"), F.lpad(F.col("event_id").cast("string"), 7, "0"))
    lines = t.events.select(
        F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream"),
        F.date_format("ts", "yyyy-MM-dd").alias("log_date"),
        F.concat(F.lit("SK."), "event_type", F.lit("_00-00-00-000")).alias("task"),
        F.concat(timestamp_to_stamp(F.col("ts")), F.lit("\tINFO Submitted application "), appid).alias("value"),
    )
    lines.hint("rebalance", "log_date").write.partitionBy("stream", "log_date", "task").text(path)
    read = logs.read_task_logs(t.spark, path).withColumn("ts", stamp_to_timestamp(F.substring("line", 1, 23)))
    tasks = read.select("otid", "opid").distinct().withColumn(
        "submission", F.when(F.col("opid").isin("SK.click", "SK.purchase"), "sync").otherwise("async"))
    status = t.events.select(
        appid.alias("appid"), F.when(F.col("props").contains("7"), "FAILED").otherwise("SUCCEEDED").alias("status"))
    outcome = build_ledger(tasks, read, status, order=["ts", "file", "block", "row"]).tasks
    return outcome.select("otid", "n_apps", F.coalesce("last_appid", F.lit("")).alias("last_appid"), "status")


def container_logs(t: Tables):
    """Container logs of every application: a stderr section of two lines and a stdout section.

    The logs of a task's seventh application are plain files, read by byte ranges; all others are compressed, in
    files of bounded size, since the text is 50 times the table it is made from.
    """
    path = scratch_path(t.spark, "container-logs")
    s = "2024-01-01_00-00-00-000\t"
    body = F.concat(F.lit("status "), "status", F.lit("\nsupplier "), F.col("tie3").cast("string"), F.lit("\n"))
    out = F.when(F.col("tie1") > 5, F.concat(F.lit("done "), F.col("tie2").cast("string"))).otherwise("")

    def section(name, text):
        return F.concat(F.lit(f"{s}LogType: \n{s}{name}\n{s}LogLength: \n{s}"), F.octet_length(text).cast("string"),
                        F.lit(f"\n{s}Log Contents:\n"), text, F.lit(s))

    container = F.concat(F.lit("container_"), F.substring("appid", 13, 100), F.lit("_01_"),
                         F.lpad(F.col("tie1").cast("string"), 6, "0"))
    block = F.concat(F.lit(f"{s}\n\nContainer: "), container, F.lit(" on node"), (F.col("tie3") % 40).cast("string"),
                     F.lit(f"_8041\n{s}" + "=" * 20 + "\n"), section("stderr", body), F.lit("\n"),
                     section("stdout", out))
    apps, plain = t.app_v, F.coalesce(F.col("tie1") == 7, F.lit(False))
    apps.filter(plain).select(block.alias("value")).write.text(f"{path}/plain")
    apps.filter(~plain).select(block.alias("value")).write.options(
        compression="gzip", maxRecordsPerFile=100_000).text(f"{path}/packed")
    return logs.read_container_logs(t.spark, path)


CONTAINER_LINES = """
  container_lines as (
    select 'node' || (tie3 % 40) || '_8041' as node, 'container_' || substr(appid, 13) || '_01_' || lpad(cast(tie1 as varchar), 6, '0') as container,
           appid, x.log_type, cast(x.log_length as bigint) as log_length, cast(x.line_no as bigint) as line_no, x.line
    from app_v, lateral (
      select 'stderr' as log_type, length('status ' || status || 'supplier ' || tie3) + 2 as log_length, 1 as line_no, 'status ' || status as line
      union all select 'stderr', length('status ' || status || 'supplier ' || tie3) + 2, 2, 'supplier ' || tie3
      union all select 'stdout', case when tie1 > 5 then length('done ' || tie2) else 0 end,
        case when tie1 > 5 then 1 else 0 end, case when tie1 > 5 then 'done ' || tie2 end) x)"""


@query("a2_read_container_logs", """
select node, container, log_type, log_length, line_no, line from container_lines""", "app_v", CONTAINER_LINES)
def a2(t):
    return container_logs(t).select("node", "container", "log_type", "log_length", "line_no", "line")


@query("c5_task_logs", """
, apps as (select o.otid, n.sequence, n.appid from wanted w
           join optask_v o on o.jobinstanceid = w.jobinstanceid and o.opid = w.opid join numbered n on n.otid = o.otid)
select a.otid, a.sequence, c.container, c.log_type, c.line_no, c.line
from apps a join container_lines c on c.appid = a.appid""", "optask_v app_v", f"{NUMBERED}, {CONTAINER_LINES}, {WANTED}")
def c5(t):
    sections = container_logs(t).withColumn("appid", logs.application_of_container(F.col("container")))
    asked_tasks = task_by_instance(t.optask_v, wanted(t))
    return task_logs(wanted(t), t.optask_v, numbered(t, asked_tasks), sections).select(
        "otid", "sequence", "container", "log_type", "line_no", "line")


@query("a6_read_ledger", "select c_custkey, c_name, c_acctbal from customer")
def a6(t):
    return tables.read_ledger(t.spark, f"{t.sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")


@query("a8_row_responses", """
select req_id, '<response>' || chr(10) || '    <errmsg></errmsg>' || chr(10) || '    <descriptor>' || chr(10) ||
       '        <udfname>' || lower(udfname) || '</udfname>' || chr(10) ||
       '        <jarname>fn.jar</jarname>' || chr(10) || '    </descriptor>' || chr(10) || '</response>' as body
from udf_request_v""", "udf_request_v")
def a8(t):
    descriptor = F.struct(F.lower("udfname").alias("udfname"), F.lit("fn.jar").alias("jarname"))
    return t.udf_request_v.select("req_id", sinks.to_response(
        [F.lit("").alias("errmsg"), descriptor.alias("descriptor")]).alias("body"))


@query("a8_list_responses", "select opid, version, descriptor from operator_v", "operator_v")
def a8_list(t):
    path = scratch_path(t.spark, "responses")
    sinks.write_responses(t.operator_v.select("opid", "version", "descriptor"), path, "response", "operator")
    return t.spark.read.format("xml").schema("opid string, version string, descriptor string").option(
        "rowTag", "operator").load(path)


@query("a9_write_logs", """
select log_date, stream, count(*) as n, min(event_id) as first_event from event_lines
where log_date between '2024-01-10' and '2024-01-19' group by log_date, stream""", extra=EVENT_LINES)
def a9(t):
    path = scratch_path(t.spark, "logs")
    lines = t.events.select(
        F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream"),
        F.date_format("ts", "yyyy-MM-dd_HH-mm-ss-SSS").alias("stamp"), "event_id")
    sinks.write_logs(lines, path)
    kept = sinks.read_logs(t.spark, path, "2024-01-10", "2024-01-19")
    return kept.groupBy("log_date", "stream").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("a10_describe_table")
def a10(t):
    t.orders.createOrReplaceTempView("jobtrail_described_orders")
    return tables.describe_table(t.spark, "jobtrail_described_orders")


@query("a11_list_files")
def a11(t):
    return files.list_files(t.spark, t.sf_dir, "*.parquet").withColumn("mtime", F.col("mtime").cast("string"))


def written_files(t: Tables) -> str:
    """Root of files of all events by type and day, with an empty one for each day of the type view."""
    root = scratch_path(t.spark, "walked")
    day = F.date_format("ts", "yyyy-MM-dd")
    name = F.concat(F.lit("group/"), "event_type", F.lit("/"), day, F.lit("/"), (F.col("user_id") % 5).cast("string"), F.lit(".log"))
    rows = t.events.select(name.alias("file"), F.col("event_id").alias("at"),
                           F.concat(F.col("event_id").cast("string"), F.lit("\n")).alias("data"))
    empty = t.events.filter("event_type = 'view'").select(
        F.concat(F.lit("group/view/"), day, F.lit("/empty.log")).alias("file"), F.lit(0).cast("bigint").alias("at"),
        F.lit("").alias("data")).distinct()
    append_to_files(rows.unionByName(empty), root)
    return root


WRITTEN = """
written as (
  select 'group/' || event_type || '/' || strftime(ts, '%Y-%m-%d') || '/' || cast(user_id % 5 as varchar) || '.log' as path,
         length(cast(event_id as varchar)) + 1 as n from events
  union all
  select distinct 'group/view/' || strftime(ts, '%Y-%m-%d') || '/empty.log', 0 from events where event_type = 'view'),
files as (select path, cast(sum(n) as bigint) as size_bytes from written group by path)"""


@query("a11_walk_files", """
select path, false as is_dir, size_bytes from files
union all select distinct 'group', true, cast(0 as bigint) from files
union all select distinct regexp_extract(path, '^group/[^/]+'), true, cast(0 as bigint) from files
union all select distinct regexp_extract(path, '^group/[^/]+/[^/]+'), true, cast(0 as bigint) from files""", extra=WRITTEN)
def a11_walk(t):
    """All files and directories, empty files included, with the sizes that were written."""
    found = files.walk_files(t.spark, written_files(t))
    return found.select("path", "is_dir", F.when(F.col("is_dir"), 0).otherwise(F.col("size_bytes")).cast("bigint").alias("size_bytes"))


@query("d4_storage_of_listing", """
select regexp_extract(path, '^group/([^/]+)', 1) as group_name, cast(sum(size_bytes) as bigint) as used_bytes, count(*) as n_files,
       coalesce(sum(size_bytes) > 20000, false) as over_quota
from files group by 1""", extra=WRITTEN)
def d4_listing(t):
    """Use of each group from a listing; empty files count as files."""
    listed = files.walk_files(t.spark, written_files(t)).filter("not is_dir")
    grouped = storage.with_group(listed.withColumn("path", F.concat(F.lit("/"), "path")), "/group/")
    quotas = grouped.select("group_name", F.lit(20000).cast("bigint").alias("quota_bytes")).distinct()
    return storage.storage_usage(grouped, quotas).drop("quota_bytes")


@query("k1_expired_of_listing", "select path, size_bytes from files where path < 'h'", extra=WRITTEN)
def k1_listing(t):
    """Retention sees empty files too: all files written just now are older than a day in the far future."""
    listed = files.walk_files(t.spark, written_files(t)).filter("not is_dir")
    return storage.split_expired(listed, "2999-01-01 00:00:00")[0].select("path", "size_bytes")


@query("c8_merge_in_place", """
, u as (select otid, status, row_number() over (partition by otid order by start_ts desc, tie1 desc, tie2 desc, tie3 desc) rn
        from app_v)
select o.otid, o.opid, o.username, coalesce(u.status, o.status) as status
from optask_v o left join u on u.otid = o.otid and u.rn = 1
where o.otid not in (select otid from asked)""", "optask_v app_v", ASKED)
def c8_in_place(t: Tables):
    """Task ledger on files: the states of the applications are one batch, the deletion of the asked tasks the next."""
    path = scratch_path(t.spark, "task-ledger")
    ledger = BucketLedger.create(t.optask_v.select("otid", "opid", "username", "status"), path, "otid", 64)
    ledger.merge(1, t.app_v, ["status"], APP_ORDER)
    ledger.merge(2, deletes=asked(t))
    return ledger.read()
