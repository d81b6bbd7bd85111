"""Lookups, parsing, ordering and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtrail.functions import parsing as P
from jobtrail.operators import keys as K
from jobtrail.operators import ledger as L
from jobtrail.operators import ordered as O
from jobtrail.plans.registry import Tables, query

APP_ORDER = ["start_ts", "tie1", "tie2", "tie3"]
APP_SQL_ORDER = "start_ts, tie1, tie2, tie3"
NUMBERED = f"""numbered as (
  select *, cast(row_number() over (partition by otid order by {APP_SQL_ORDER}) as integer) as sequence
  from app_v)"""
# Requested ids: every customer key read as a task id, so some exist and some do not.
ASKED = "asked as (select cast(c_custkey * 13 as varchar) as otid from customer)"


def asked(t: Tables):
    return t.customer.select((F.col("c_custkey") * 13).cast("string").alias("otid"))


def numbered(t: Tables, only=None):
    """The application table with its sequence, of all tasks or of the requested ones only."""
    apps = t.app_v if only is None else t.app_v.join(only, "otid", "left_semi")
    return L.number_apps(apps, APP_ORDER)


def text(ts: str):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


@query("b1_task_status", """
select a.otid, case when o.otid is null then 'NOT_EXIST' else o.status end as status,
       strftime(o.submit_ts, '%Y-%m-%d %H:%M:%S') as submit_ts
from asked a left join optask_v o on a.otid = o.otid""", "optask_v", ASKED)
def b1(t):
    return K.task_status(t.optask_v, asked(t)).select("otid", "status", text("submit_ts"))


WANTED = """wanted as (
    select distinct 'j' || cast(c_custkey * 13 as varchar) as jobinstanceid,
           case c_custkey * 13 % 4 when 0 then 'GM' when 1 then 'SK' when 2 then 'XX' else 'HV' end || '.op' ||
             cast(c_custkey * 13 % 50 as varchar) as opid from customer)"""


def wanted(t: Tables):
    """Requested (jobinstanceid, opid) pairs: one per customer, some known, some not."""
    n = F.col("c_custkey") * 13
    engine = F.when(n % 4 == 0, "GM").when(n % 4 == 1, "SK").when(n % 4 == 2, "XX").otherwise("HV")
    return t.customer.select(
        F.concat(F.lit("j"), n.cast("string")).alias("jobinstanceid"),
        F.concat(engine, F.lit(".op"), (n % 50).cast("string")).alias("opid"))


@query("b2_task_by_instance", """
, ranked as (select jobinstanceid, opid, otid, row_number() over (
               partition by jobinstanceid, opid order by submit_ts desc, otid desc) as rn from optask_v)
select w.jobinstanceid, w.opid, coalesce(r.otid, 'NOT_EXIST') as otid
from wanted w left join ranked r on r.rn = 1 and r.jobinstanceid = w.jobinstanceid and r.opid = w.opid
""", "optask_v", WANTED)
def b2(t):
    return K.task_by_instance(t.optask_v, wanted(t))


@query("b3_apps_of_task", """
select n.otid, n.sequence, n.appid from numbered n where n.otid in (select otid from asked)
""", "app_v", f"{NUMBERED}, {ASKED}")
def b3(t):
    return K.apps_of_task(numbered(t, asked(t)), asked(t))


@query("b4_unfinished_apps", """
select otid, appid, status from app_v
where otid in (select otid from asked) and not (status = 'SUCCEEDED' or status = 'FAILED')
""", "app_v", ASKED)
def b4(t):
    return K.unfinished_apps(t.app_v, asked(t)).select("otid", "appid", "status")


@query("b4_unfinished_apps_strict", """
select otid, appid, status from app_v
where otid in (select otid from asked) and status = 'RUNNING'
""", "app_v", ASKED)
def b4_strict(t):
    return K.unfinished_apps(t.app_v, asked(t), strict=True).select("otid", "appid", "status")


@query("b5_udf_names", "select udfname from udf_v", "udf_v")
def b5(t):
    return t.udf_v.select("udfname")


@query("b6_fetch_operator", """
select opid, version, provider, opjarpath, descriptor from operator_v
where opid in (select 'SK.op' || cast(s_suppkey as varchar) from supplier)""", "operator_v")
def b6(t):
    wanted = t.supplier.select(F.concat(F.lit("SK.op"), F.col("s_suppkey").cast("string")).alias("opid"))
    return K.fetch(t.operator_v, wanted, "opid", ["opid", "version", "provider", "opjarpath", "descriptor"])


@query("b7_extract_app_ids", """
select otid, stream, tie1, tie2, tie3, right(line, strpos(reverse(line), ' ') - 1) as appid
from logline_v where line like '%Submitted application%'""", "logline_v")
def b7(t):
    return P.extract_app_ids(t.logline_v).select("otid", "stream", "tie1", "tie2", "tie3", "appid")


@query("b7_extract_app_ids_strict", """
select otid, stream, tie1, tie2, tie3, split_part(line, 'application ', 2) as appid
from logline_v where line like '%Submitted application%' and length(split_part(line, '_', 3)) = 4
""", "logline_v")
def b7_strict(t):
    return P.extract_app_ids(t.logline_v, strict=True).select("otid", "stream", "tie1", "tie2", "tie3", "appid")


@query("b8_parse_app_id", """
select otid, tie1, tie2, tie3, cast(split_part(appid, '_', 2) as bigint) as cluster_ts,
       cast(split_part(appid, '_', 3) as bigint) as number from app_v""", "app_v")
def b8(t):
    return t.app_v.select("otid", "tie1", "tie2", "tie3", P.parse_app_id(F.col("appid")).alias("id")).select(
        "otid", "tie1", "tie2", "tie3", "id.cluster_ts", "id.number")


@query("b9_stamp_parts", """
select event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S-%g') as stamp, strftime(ts, '%Y-%m-%d') as stamp_date,
       strftime(ts, '%H-%M-%S-%g') as stamp_time, epoch_us(ts) // 1000 as stamp_ms from events""")
def b9(t):
    stamped = t.events.select("event_id", P.timestamp_to_stamp(F.col("ts")).alias("stamp"))
    return P.stamp_parts(stamped, "stamp").select(
        "event_id", "stamp", "stamp_date", "stamp_time", F.unix_millis("stamp_ts").alias("stamp_ms"))


@query("b10_engine_of", """
select req_id, case when strpos(opid, '.') > 0 then split_part(opid, '.', 1) else '' end as engine,
       case when opid like 'HV.%' then 'hive' else 'yarn' end as tracker
from operator_request_v""", "operator_request_v")
def b10(t):
    return t.operator_request_v.select(
        "req_id", F.coalesce(P.engine_of(F.col("opid")), F.lit("")).alias("engine"),
        P.engine_class(F.col("opid")).alias("tracker"))


@query("b11_parse_quota", """
select p_partkey, case when p_brand like '%1' then -1 else cast(p_size as bigint) * 1073741824 end as bytes
from part""")
def b11(t):
    quota = F.concat(F.when(F.col("p_brand").endswith("1"), "x").otherwise(F.col("p_size").cast("string")), F.lit("GB"))
    return t.part.select("p_partkey", F.coalesce(P.parse_quota(quota), F.lit(-1)).alias("bytes"))


@query("e1_number_apps", "select otid, tie1, tie2, tie3, appid, sequence from numbered", "app_v", NUMBERED)
def e1(t):
    return numbered(t).select("otid", "tie1", "tie2", "tie3", "appid", "sequence")


@query("e2_app_intervals", f"""
select otid, sequence, appid, strftime(start_ts, '%Y-%m-%d %H:%M:%S') as start_ts,
       strftime(coalesce(lead(start_ts) over (partition by otid order by sequence), timestamp '2002-01-01'),
                '%Y-%m-%d %H:%M:%S') as end_ts from numbered""", "app_v", NUMBERED)
def e2(t):
    apps = t.app_v.withColumn("log_end", F.lit("2002-01-01").cast("timestamp_ntz"))
    return L.app_intervals(apps, APP_ORDER, "log_end").select(
        "otid", "sequence", "appid", text("start_ts"), text("end_ts"))


@query("e3_final_status", """
, last as (select n.otid, n.status, n.sequence from numbered n
           join (select otid, max(sequence) m from numbered group by otid) x on x.otid = n.otid and x.m = n.sequence)
select o.otid, cast(coalesce(l.sequence, 0) as bigint) as n_apps, coalesce(l.status, 'FINISHED') as status
from optask_v o left join last l on l.otid = o.otid""", "optask_v app_v", NUMBERED)
def e3(t):
    return L.final_status(t.optask_v, t.app_v, APP_ORDER)


@query("e4_first_by_position", """
select group_name, name as first_value from (
  select group_name, name, row_number() over (partition by group_name order by pos) rn
  from role_v where type = 'NODEMANAGER' and ha_status = 'ACTIVE') where rn = 1""", "role_v")
def e4(t):
    matches = (F.col("type") == "NODEMANAGER") & (F.col("ha_status") == "ACTIVE")
    return O.first_by_position(t.role_v, ["group_name"], "name", "pos", matches)


@query("e6_last_by_position", """
select username, otid as last_value from (
  select username, otid, row_number() over (partition by username order by submit_ts desc, otid desc) rn
  from optask_v) where rn = 1""", "optask_v")
def e6(t):
    return O.last_by_position(t.optask_v, ["username"], "otid", F.struct("submit_ts", "otid"))


FOUND = """found as (select otid, ts, tie1, tie2, tie3, stream, split_part(line, 'application ', 2) as appid
                     from logline_v where line like '%Submitted application%'),
  picked as (select f.* from found f left join optask_v o on o.otid = f.otid
             where f.stream = 'stderr' or (o.submission = 'sync' and not exists (
               select 1 from found e where e.otid = f.otid and e.stream = 'stderr')))"""
LEDGER = FOUND + """,
  status as (select appid, arg_max(status, row(start_ts, tie1, tie2, tie3, otid)) as status from app_v group by appid),
  seq as (select p.*, cast(row_number() over w as integer) as sequence, lead(ts) over w as next_ts
          from picked p window w as (partition by otid order by ts, tie1, tie2, tie3)),
  ends as (select otid, max(ts) as end_ts from found group by otid),
  ledger as (select s.otid, s.appid, s.sequence, s.ts as start_ts, coalesce(s.next_ts, e.end_ts) as end_ts,
                    coalesce(st.status, 'RUNNING') as status
             from seq s join ends e on e.otid = s.otid left join status st on st.appid = s.appid)"""
OUTCOME = """
  outcome as (select o.otid, o.opid, cast(coalesce(l.sequence, 0) as bigint) as n_apps,
                     coalesce(l.appid, '') as last_appid, coalesce(l.status, 'FINISHED') as status
              from optask_v o left join (
                select *, row_number() over (partition by otid order by sequence desc) rn from ledger) l
                on l.otid = o.otid and l.rn = 1)"""


def ledger(t: Tables) -> L.Ledger:
    status = L.latest_app_status(t.app_v, [*APP_ORDER, "otid"])
    return L.build_ledger(t.optask_v, t.logline_v, status)


@query("g2_app_ids_with_fallback", "select otid, stream, appid, tie1, tie2, tie3 from picked",
       "logline_v optask_v", FOUND)
def g2(t):
    ids = P.extract_app_ids(t.logline_v)
    return L.app_ids_with_fallback(ids, t.optask_v).select("otid", "stream", "appid", "tie1", "tie2", "tie3")


@query("h1_ledger_apps", """
select otid, appid, sequence, strftime(start_ts, '%Y-%m-%d %H:%M:%S') as start_ts,
       strftime(end_ts, '%Y-%m-%d %H:%M:%S') as end_ts, status from ledger""", "logline_v optask_v", LEDGER)
def h1_apps(t):
    return ledger(t).apps.select("otid", "appid", "sequence", text("start_ts"), text("end_ts"), "status")


@query("h1_ledger_tasks", "select * from outcome", "logline_v optask_v", f"{LEDGER}, {OUTCOME}")
def h1_tasks(t):
    return ledger(t).tasks.withColumn("last_appid", F.coalesce("last_appid", F.lit("")))


HIVE = """
  hive as (select o.otid, case when h.state in ('INITIALIZED_STATE', 'RUNNING_STATE', 'PENDING_STATE') then 'RUNNING'
                               when h.state = 'FINISHED_STATE' then 'SUCCEEDED'
                               when h.state = 'CANCELED_STATE' then 'KILLED' else 'FAILED' end as status
           from optask_v o left join (select otid, arg_max(state, submittime) as state from hiveinstance_v group by otid) h
             on h.otid = o.otid where o.opid like 'HV.%')"""


@query("h2_hive_task_status", "select otid, status from hive", "optask_v hiveinstance_v", HIVE)
def h2(t):
    return L.hive_task_status(t.optask_v, t.hiveinstance_v)


@query("h3_task_outcomes", """
select otid, status, 'yarn' as tracker from outcome where opid not like 'HV.%'
union all select otid, status, 'hive' from hive""",
       "logline_v optask_v hiveinstance_v", f"{LEDGER}, {OUTCOME}, {HIVE}")
def h3(t):
    return L.task_outcomes(t.optask_v, ledger(t).tasks, t.hiveinstance_v)


RESULTS = """
  docs as (select o_orderkey, cast(o_orderkey as varchar) as otid,
             case when o_orderkey % 3 = 0 then '/tmp/' || o_orderkey || '/' else '/tmp/' || o_orderkey end as base_path,
             case when o_totalprice > 200000 then '<response><v>' || o_custkey || '</v></response>' end as stdout,
             case when o_totalprice < 350000 and o_orderpriority <> '5-LOW'
                  then '<error><v>' || o_custkey || '</v></error>' end as stderr from orders),
  results as (select otid, case when stdout is not null then 'stdout' when stderr is not null then 'stderr'
                                else 'error' end as source,
                case when stdout is not null then stdout when stderr is not null then stderr
                     else '/tmp/' || o_orderkey || '/stdout.xml and /tmp/' || o_orderkey || '/stderr.xml not exist'
                end as result from docs)"""


def results(t: Tables):
    docs = t.sql("""
      select cast(o_orderkey as string) as otid,
             '/tmp/' || o_orderkey || case when o_orderkey % 3 = 0 then '/' else '' end as base_path,
             o_totalprice, o_orderpriority, o_custkey from {orders}""")
    out = docs.filter("o_totalprice > 200000").selectExpr(
        "otid", "'<response><v>' || o_custkey || '</v></response>' as stdout")
    err = docs.filter("o_totalprice < 350000 and o_orderpriority <> '5-LOW'").selectExpr(
        "otid", "'<error><v>' || o_custkey || '</v></error>' as stderr")
    return L.resolve_result(docs, out, err)


@query("c6_resolve_result", "select * from results", extra=RESULTS)
def c6(t):
    return results(t)


@query("h4_apply_kill", """
select r.otid, case when o.status = 'KILLED' then 'error' else r.source end as source,
       case when o.status = 'KILLED' then 'the optask is killed' else r.result end as result
from results r join optask_v o on o.otid = r.otid""", "optask_v", RESULTS)
def h4(t):
    return L.apply_kill(results(t), t.optask_v)


PLAN = """
  state as (select a.otid, case when o.otid is null then 'NOT_EXIST' when o.status <> 'RUNNING' then 'ALREADY_FINISHED'
                                when o.opid like 'HV.%' then 'HIVE_CANCEL' else 'KILL_APPLICATION' end as action
            from asked a left join optask_v o on o.otid = a.otid),
  plan as (select s.otid, s.action, n.sequence, n.appid from state s
           left join numbered n on s.action = 'KILL_APPLICATION' and n.otid = s.otid
                and n.status not in ('SUCCEEDED', 'FAILED'))"""


def plan(t: Tables):
    return L.kill_plan(asked(t), t.optask_v, numbered(t, asked(t)))


@query("h5_kill_plan", """
select otid, action, coalesce(sequence, 0) as sequence, coalesce(appid, '') as appid,
       case action when 'NOT_EXIST' then 'the optask ''' || otid || ''' is not exist'
                   when 'ALREADY_FINISHED' then 'the optask ''' || otid || ''' is FINISHED' else '' end as message from plan""",
       "optask_v app_v", f"{NUMBERED}, {ASKED}, {PLAN}")
def h5(t):
    return plan(t).select("otid", "action", F.coalesce("sequence", F.lit(0)).alias("sequence"),
                          F.coalesce("appid", F.lit("")).alias("appid"), "message")


# Instances by user, so that one instance and operator have several tasks; some pairs have none.
BY_INSTANCE = """
  latest as (select username as jobinstanceid, opid, arg_max(otid, {'t': submit_ts, 'o': otid}) as otid
             from optask_v group by username, opid),
  pairs as (select jobinstanceid, opid, otid from latest
            union all select 'u' || cast(c_custkey as varchar), 'XX.none', null from customer),
  asked as (select otid from pairs where otid is not null)"""


@query("h5_kill_by_instance", """
select p.jobinstanceid, p.opid, coalesce(p.otid, '') as otid, coalesce(x.action, 'NOT_EXIST') as action,
       coalesce(x.sequence, 0) as sequence, coalesce(x.appid, '') as appid,
       case when p.otid is null then 'the opTask(' || p.opid || ') of jobinstanceid( ' || p.jobinstanceid || ')  is not submitted to the yarn'
            when x.action = 'ALREADY_FINISHED' then 'the optask ''' || p.otid || ''' is FINISHED' else '' end as message
from pairs p left join plan x on x.otid = p.otid""", "optask_v app_v", f"{NUMBERED}, {BY_INSTANCE}, {PLAN}")
def h5_by_instance(t):
    tasks = t.optask_v.withColumn("jobinstanceid", F.col("username"))
    unknown = t.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("jobinstanceid"), F.lit("XX.none").alias("opid"))
    steps = L.kill_by_instance(tasks.select("jobinstanceid", "opid").unionByName(unknown), tasks, numbered(t))
    return steps.select("jobinstanceid", "opid", F.coalesce("otid", F.lit("")).alias("otid"), "action",
                        F.coalesce("sequence", F.lit(0)).alias("sequence"), F.coalesce("appid", F.lit("")).alias("appid"), "message")


@query("d7_kill_outcome", """
, fails as (select otid, min(sequence) as m from numbered where status = 'FAILED' group by otid)
select n.otid, f.m is null as all_killed, coalesce(max(case when n.sequence = f.m then n.appid end), '') as first_failure,
       case when f.m is null then 'KILLED' else 'RUNNING' end as status,
       case when f.m is null then '' else 'the application ''' || max(case when n.sequence = f.m then n.appid end) ||
            ''' is not normal to kill, Please check the operator task status' end as message
from numbered n left join fails f on f.otid = n.otid group by n.otid, f.m""", "app_v", NUMBERED)
def d7(t):
    apps = numbered(t).withColumn("killed", F.col("status") != "FAILED")
    return L.kill_outcome(apps).withColumn("first_failure", F.coalesce("first_failure", F.lit("")))


@query("c5_log_requests", """
, apps as (select otid, count(*) as n_apps from app_v group by otid)
select w.jobinstanceid, w.opid, coalesce(o.otid, 'NOT_EXIST') as otid, coalesce(a.n_apps, 0) as n_apps,
       case when o.otid is null then 'the opTask(' || w.opid || ') of jobinstanceid(' || w.jobinstanceid || ') is not exist'
            when a.n_apps is null then '当前算子标准输出流中没有截获到ApplicationId，请确认是否用了log4j处理日志，应该使用标准输出'
            else '' end as message
from wanted w left join optask_v o on o.jobinstanceid = w.jobinstanceid and o.opid = w.opid
     left join apps a on a.otid = o.otid""", "optask_v app_v", WANTED)
def c5_requests(t):
    return L.log_requests(wanted(t), t.optask_v, t.app_v)


@query("h6_start_tasks", """
select opid || strftime(submit_ts, '%Y-%m-%d_%H-%M-%S-%g') as otid, opid, processid, jobinstanceid, username,
       case when queuename = '3-MEDIUM' then 'default' else queuename end as queuename,
       strftime(submit_ts, '%Y-%m-%d_%H-%M-%S-%g') as submittime, submission, 'RUNNING' as status
from optask_v""", "optask_v")
def h6(t):
    requests = t.optask_v.withColumn("queuename", F.nullif("queuename", F.lit("3-MEDIUM")))
    return L.start_tasks(requests)


@query("c1_existing_operators", """
select req_id, opid from operator_request_v where opid in (select opid from operator_v)""",
       "operator_request_v operator_v")
def c1_existing(t):
    return K.split_existing(t.operator_request_v, t.operator_v, "opid")[0].select("req_id", "opid")


@query("c1_missing_operators", """
select req_id, opid from operator_request_v r where not exists (select 1 from operator_v o where o.opid = r.opid)""",
       "operator_request_v operator_v")
def c1_missing(t):
    return K.split_existing(t.operator_request_v, t.operator_v, "opid")[1].select("req_id", "opid")


@query("c1_mark_existing", """
select r.req_id, r.opid, exists (select 1 from operator_v o where o.opid = r.opid) as "exists"
from operator_request_v r""", "operator_request_v operator_v")
def c1_mark(t):
    return K.mark_existing(t.operator_request_v, t.operator_v, "opid").select("req_id", "opid", "exists")


@query("c8_apply_updates", """
, u as (select otid, status, row_number() over (partition by otid order by start_ts desc, tie1 desc, tie2 desc, tie3 desc) rn
        from app_v)
select o.otid, o.opid, o.username, coalesce(u.status, o.status) as status
from optask_v o left join u on u.otid = o.otid and u.rn = 1""", "optask_v app_v")
def c8(t):
    return K.apply_updates(t.optask_v, t.app_v, "otid", ["status"], APP_ORDER).select(
        "otid", "opid", "username", "status")


@query("c9_apply_deletes", """
select otid, opid, status from optask_v where otid not in (select otid from asked)""", "optask_v", ASKED)
def c9(t):
    return K.apply_deletes(t.optask_v, asked(t), "otid").select("otid", "opid", "status")
