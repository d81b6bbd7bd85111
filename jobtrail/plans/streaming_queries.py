"""Streams over files that Spark writes from the test tables, step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C
from jobtrail.fixtures import append_to_files
from jobtrail.functions.parsing import extract_app_ids
from jobtrail.operators.ledger import latest_app_status
from jobtrail.plans.ledger_queries import APP_ORDER, FOUND, LEDGER, OUTCOME, text
from jobtrail.plans.registry import Tables, query
from jobtrail.session import scratch_path
from jobtrail.streaming import follow as S

# Lines arrive in three steps by time; inside a step the order columns decide. The first step is open
# downwards and holds NULL times, which sort first; the last one is open upwards.
STEPS = ("1997-01-01", "1999-01-01", None)


def in_steps(df, time: str):
    since = None
    for until in STEPS:
        lower, upper = (F.lit(d).cast("timestamp_ntz") for d in (since, until))
        begun = F.col(time) >= lower if since else F.lit(True)
        ended = F.col(time) < upper if until else F.lit(True)
        inside = begun & ended
        yield df.filter(inside if since else F.col(time).isNull() | inside)
        since = until


@query("l1_stream_app_ids", """
select 'SK.' || event_type || strftime(ts, '%Y-%m-%d') || '_00-00-00-000' as otid,
       case when event_type = 'error' then 'stderr' else 'stdout' end as stream,
       'application_1700000000000_' || lpad(cast(event_id as varchar), 7, '0') as appid
from events where event_type <> 'view'""")
def l1(t: Tables):
    path, out, mark = (scratch_path(t.spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    word = F.when(F.col("event_type") == "view", "Accepted").otherwise("Submitted application")
    lines = t.events.select(
        F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream"),
        F.date_format("ts", "yyyy-MM-dd").alias("log_date"),
        F.concat(F.lit("SK."), "event_type", F.lit("_00-00-00-000")).alias("task"),
        F.concat(word, F.lit(" application_1700000000000_"), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("value"),
    )
    lines.hint("rebalance", "log_date").write.partitionBy("stream", "log_date", "task").text(path)
    stream = S.stream_app_ids(t.spark, path)
    stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(
        availableNow=True).start(out).awaitTermination()
    return t.spark.read.parquet(out).select("otid", "stream", "appid")


def growing_logs(t: Tables, line: Column) -> list[DataFrame]:
    """Lines of all events as pieces of files that grow in three steps by time: (file, at, data).

    The last line of a file in a step is cut in two; the rest of it comes first in the next step.
    """
    step = F.when(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"), 0).when(
        F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), 1).otherwise(2)
    stream = F.when(F.col("event_type") == "error", "stderr").otherwise("stdout")
    rows = t.events.select(
        F.concat(stream, F.lit("/"), F.date_format("ts", "yyyy-MM"), F.lit("-01/SK."), "event_type", F.lit("_00-00-00-000.log")).alias("file"),
        step.alias("step"), F.col("event_id").alias("at"), F.concat(line, F.lit("\n")).alias("data"))
    last = rows.filter("step < 2").groupBy("file", "step").agg(F.max("at").alias("at")).withColumn("cut", F.lit(True))
    rows = rows.join(last, ["file", "step", "at"], "left")
    head = F.when(F.col("cut"), F.substring("data", 1, 20)).otherwise(F.col("data"))
    pieces = rows.select("file", "step", "at", head.alias("data")).unionByName(rows.filter("cut").select(
        "file", (F.col("step") + 1).alias("step"), F.lit(-1).cast("bigint").alias("at"), F.expr("substring(data, 21)").alias("data")))
    return [pieces.filter(F.col("step") == k) for k in range(3)]


@query("l1_stream_growing", """
select 'SK.' || event_type || strftime(ts, '%Y-%m') || '-01_00-00-00-000' as otid,
       case when event_type = 'error' then 'stderr' else 'stdout' end as stream,
       'application_1700000000000_' || lpad(cast(event_id as varchar), 7, '0') as appid
from events where event_type <> 'view'""")
def l1_growing(t: Tables):
    """The files grow twice, in the middle of a line, and the stream is started again each time."""
    path, out, mark = (scratch_path(t.spark, n) for n in ("growing-in", "growing-out", "growing-mark"))
    word = F.when(F.col("event_type") == "view", "Accepted").otherwise("Submitted application")
    line = F.concat(word, F.lit(" application_1700000000000_"), F.lpad(F.col("event_id").cast("string"), 7, "0"))
    for pieces in growing_logs(t, line):
        append_to_files(pieces, path)
        S.stream_growing_app_ids(t.spark, path, split_bytes=1 << 20).writeStream.format("parquet").option(
            "checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.parquet(out).select("otid", "stream", "appid")


@query("l2_stream_tasks", "select * from outcome", "logline_v optask_v", f"{LEDGER}, {OUTCOME}")
def l2_tasks(t):
    """Outcome of every task from its lines, in three steps, and its end."""
    source, out, mark = (scratch_path(t.spark, n) for n in ("tasks-in", "tasks-out", "tasks-mark"))
    lines = t.logline_v.withColumn("submission", F.lit(None).cast("string"))
    ends = t.optask_v.select("otid", F.lit("end").alias("stream"), "submission")
    steps = [*in_steps(lines, "ts"), lines.limit(0).unionByName(ends, allowMissingColumns=True)]
    for step in steps:
        step.write.mode("append").option("compression", "zstd").parquet(source)
        events = t.spark.readStream.schema(lines.schema).parquet(source)
        ids = extract_app_ids(events.filter("stream <> 'end'")).drop("line").unionByName(
            events.filter("stream = 'end'").drop("line"), allowMissingColumns=True)
        S.stream_tasks(ids, out, mark, ["ts", "tie1", "tie2", "tie3"], compact_every=2).awaitTermination()
    ended = t.spark.read.parquet(f"{out}/ended").drop("batch")
    status = latest_app_status(t.app_v, [*APP_ORDER, "otid"]).withColumnsRenamed({"appid": "last_appid", "status": "_status"})
    return t.optask_v.select("otid", "opid").join(ended, "otid").join(status, "last_appid", "left").select(
        "otid", "opid", "n_apps", F.coalesce("last_appid", F.lit("")).alias("last_appid"),
        F.when(F.col("last_appid").isNull(), C.FINISHED).otherwise(F.coalesce("_status", F.lit(C.RUNNING))).alias("status"))


@query("l2_stream_ledger", """
select otid, sequence, appid, strftime(ts, '%Y-%m-%d %H:%M:%S') as start_ts,
       coalesce(strftime(next_ts, '%Y-%m-%d %H:%M:%S'), '') as end_ts
from (select otid, appid, ts, cast(row_number() over w as integer) as sequence, lead(ts) over w as next_ts
      from found window w as (partition by otid order by ts, tie1, tie2, tie3))""", "logline_v optask_v", FOUND)
def l2(t):
    source, out, mark = (scratch_path(t.spark, n) for n in ("ledger-in", "ledger-out", "ledger-mark"))
    lines = t.logline_v
    for step in in_steps(lines, "ts"):
        step.write.mode("append").option("compression", "zstd").parquet(source)
        ids = extract_app_ids(t.spark.readStream.schema(lines.schema).parquet(source))
        S.stream_ledger(ids, out, mark, ["ts", "tie1", "tie2", "tie3"]).awaitTermination()
    ledger = S.close_intervals(t.spark.read.parquet(f"{out}/ledger"))
    return ledger.select("otid", "sequence", "appid", text("ts").alias("start_ts"),
                         F.coalesce(text("end_ts"), F.lit("")).alias("end_ts"))


@query("l3_stream_status", """
, u as (select otid, status, row_number() over (partition by otid order by start_ts desc, tie1 desc, tie2 desc, tie3 desc) rn
        from app_v)
select o.otid, coalesce(u.status, o.status) as status
from optask_v o left join u on u.otid = o.otid and u.rn = 1""", "optask_v app_v")
def l3(t):
    source, deltas, mark = (scratch_path(t.spark, n) for n in ("status-in", "status-deltas", "status-mark"))
    updates = t.app_v.select("otid", "status", *APP_ORDER)
    for step in in_steps(updates, "start_ts"):
        step.write.mode("append").option("compression", "zstd").parquet(source)
        stream = t.spark.readStream.schema(updates.schema).parquet(source)
        S.stream_status(stream, deltas, mark, "otid", ["status"], APP_ORDER, compact_every=2).awaitTermination()
    return S.current_status(t.optask_v, deltas, "otid", ["status"], APP_ORDER).select("otid", "status")
