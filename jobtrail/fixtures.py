"""Ledger tables and documents derived from the star-schema test tables, as DataFrames.

The SQL is plain enough for any engine; table names in braces are bound by the caller.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

VIEWS = {
    "optask_v": """
select cast(o_orderkey as string) as otid,
       case o_orderkey % 4 when 0 then 'GM' when 1 then 'SK' when 2 then 'MR' else 'HV' end
         || '.op' || cast(o_orderkey % 50 as string) as opid,
       'p' || cast(o_custkey % 20 as string) as processid,
       'j' || cast(o_orderkey as string) as jobinstanceid,
       'u' || cast(o_custkey as string) as username,
       o_orderpriority as queuename, o_orderdate as submit_ts,
       case when o_orderkey % 2 = 0 then 'sync' else 'async' end as submission,
       case o_orderstatus when 'F' then 'SUCCEEDED' when 'O' then 'RUNNING' else 'KILLED' end as status
from {orders}""",
    "app_v": """
select cast(l_orderkey as string) as otid,
       'application_17' || lpad(cast(l_orderkey as string), 11, '0') || '_' ||
         case when l_partkey * 7 < 10000 then lpad(cast(l_partkey * 7 as string), 4, '0')
              else cast(l_partkey * 7 as string) end as appid,
       l_shipdate as start_ts, l_linenumber as tie1, l_partkey as tie2, l_suppkey as tie3,
       case when l_returnflag = 'A' then 'SUCCEEDED' when l_returnflag = 'N' then 'RUNNING'
            when l_linestatus = 'O' then 'KILLED' else 'FAILED' end as status
from {lineitem}""",
    "logline_v": """
select a.otid, a.start_ts as ts, a.tie1, a.tie2, a.tie3,
       case when cast(a.otid as bigint) % 3 = 0 or a.tie1 = 7 then 'stdout' else 'stderr' end as stream,
       'INFO impl.YarnClientImpl: Submitted application ' || a.appid as line
from {app_v} a
union all
select otid, start_ts, tie1, tie2, tie3, 'stderr', 'INFO mapreduce.Job:  map 0% reduce 0% ' || appid
from {app_v} where tie1 = 2""",
    "hiveinstance_v": """
select otid, case cast(otid as bigint) % 9 when 0 then 'INITIALIZED_STATE' when 1 then 'RUNNING_STATE'
         when 2 then 'FINISHED_STATE' when 3 then 'CANCELED_STATE' when 4 then 'CLOSED_STATE'
         when 5 then 'ERROR_STATE' when 6 then 'UKNOWN_STATE' else 'PENDING_STATE' end as state, 2 as submittime
from {optask_v} where opid like 'HV.%' and cast(otid as bigint) % 5 <> 0
union all
select otid, 'RUNNING_STATE', 1 from {optask_v} where opid like 'HV.%' and cast(otid as bigint) % 15 in (3, 6, 9, 12)
union all
select otid, 'FINISHED_STATE', 3 from {optask_v} where opid like 'HV.%' and cast(otid as bigint) % 7 = 0""",
    "operator_request_v": """
select case when p_partkey % 17 = 0 then '' when p_partkey % 13 = 0 then 'SK op' || cast(p_partkey as string)
            when p_partkey % 19 = 0 then 'SKop' || cast(p_partkey as string)
            else case p_partkey % 5 when 0 then 'GM' when 1 then 'SK' when 2 then 'MR' when 3 then 'HV' else 'XX' end
                 || '.op' || cast(p_partkey as string) end as opid,
       'v' || cast(p_size as string) as version, p_type as biztype, p_brand as provider,
       case when p_partkey % 23 = 0 then '' else '/ops/' || cast(p_partkey as string) || '.zip' end as opjarpath,
       case when p_partkey % 29 = 0 then repeat('d', 1025) else p_name end as descriptor,
       p_partkey as req_id
from {part}""",
    "operator_v": """
select opid, version, biztype, provider, opjarpath, descriptor, req_id from {operator_request_v}
where opid like '%.op%' and opid not like 'XX%' and opjarpath <> '' and length(descriptor) <= 1024
  and length(provider) > 7""",
    "package_entry_v": """
select distinct opid, opid || '/' || entry as entry from (
  select r.opid, case l.l_linenumber when 1 then 'run.sh' when 2 then r.opid || '.jar'
           when 3 then 'description.xml' when 4 then 'ui.xml' when 5 then 'lib/Dshell2.5.0V2.jar'
           else 'lib/dep.jar' end as entry
  from {lineitem} l join {operator_request_v} r
    on r.opjarpath = '/ops/' || cast(l.l_partkey as string) || '.zip'
  where l.l_quantity < 25) x""",
    "package_path_v": """
select distinct '/ops/' || cast(l_partkey as string) || '.zip' as path
from {lineitem} where l_quantity < 3""",
    "script_line_v": """
select r.opid, l.l_orderkey as line_no, l.l_linenumber as line_sub, l.l_suppkey as line_sub2,
       case when l.l_returnflag = 'R' and l.l_quantity < 2 then 'hadoop jar lib/Dshell2.5.0V2.jar Client -x'
            when l.l_returnflag = 'A' and l.l_quantity < 6 then '  # hadoop jar lib/Dshell2.5.0V2.jar Client'
            else 'echo step ' || cast(l.l_linenumber as string) end as line
from {lineitem} l join {operator_request_v} r
  on r.opjarpath = '/ops/' || cast(l.l_partkey as string) || '.zip'""",
    "udf_request_v": """
select p_partkey as req_id,
       case when p_partkey % 11 = 0 then 'Sum' when p_partkey % 7 = 0 then upper(replace(p_name, ' ', '_'))
            else replace(p_name, ' ', '_') || '_' || cast(p_partkey % 90 as string) end as udfname
from {part}""",
    "udf_v": """
select distinct lower(udfname) as udfname from {udf_request_v}
where lower(udfname) like 'small%'""",
    "funcs_v": """
select distinct lower(udfname) as func_name from {udf_request_v}
where lower(udfname) like '%ring%'""",
    "udf_registry_v": """
select replace(p_name, ' ', '_') || '_' || cast(p_partkey % 300 as string) as udfname, min(p_type) as descriptor,
       min(p_brand) as author
from {part} where p_name like 'small%' or p_name like '%ring' group by 1""",
    "udf_event_v": """
select p_partkey as req_id,
       case when p_partkey % 3 = 0 then 'busy_fn' else replace(p_name, ' ', '_') || '_' || cast(p_partkey % 300 as string) end as udfname,
       case p_partkey % 7 when 0 then 'delete' when 1 then 'update' when 2 then 'update' when 3 then 'delete' when 4 then 'update'
            else 'register' end as kind,
       p_type || ' ' || cast(p_partkey as string) as descriptor, p_brand || '/' || cast(p_size as string) as author,
       case when p_size = 46 then 'the descriptor is too long' else '' end as error
from {part}""",
    "role_v": """
select s_suppkey as pos, s_name as name,
       case when s_suppkey % 10 = 0 then 'RESOURCEMANAGER' else 'NODEMANAGER' end as type,
       case when s_suppkey % 20 = 0 then 'STANDBY' when s_acctbal < 0 then 'UNKNOWN' else 'ACTIVE' end as ha_status,
       'group-' || cast(s_nationkey as string) as group_name
from {supplier}""",
    "role_group_v": """
select 'group-' || cast(n_nationkey as string) as group_name,
       1024 * (n_nationkey + 1) as memory_mb, n_nationkey % 8 + 1 as vcores
from {nation}""",
    "queue_v": """
select o_orderpriority as queue_name, 20.0e0 as capacity, 60.0e0 as max_capacity,
       cast(substr(o_orderpriority, 1, 1) as double) as user_limit_factor,
       count(*) as max_applications, cast(max(o_custkey) as double) as mem_used,
       cast(count(distinct o_orderdate) % 50 as double) as vcores_used,
       sum(case when o_orderstatus = 'O' then 1 else 0 end) as active_applications,
       sum(case when o_orderstatus = 'P' then 1 else 0 end) as pending_applications
from {orders} group by o_orderpriority""",
    "queue_app_v": """
select a.appid, t.queuename as queue_name,
       case when a.status = 'RUNNING' then 'RUNNING' else 'FINISHED' end as state
from {app_v} a join {optask_v} t on a.otid = t.otid where t.queuename <> '5-LOW'""",
    "file_v": """
select event_type as group_name, '/user/department/' || event_type || '/' || cast(event_id as string) as path,
       cast(floor(value * 100) as bigint) as size_bytes, ts as mtime
from {events}""",
    "task_request_v": """
select o_orderkey as req_id,
       case when o_orderkey % 13 = 0 then repeat('j', 129) else 'j' || cast(o_orderkey as string) end as jobinstanceid,
       case when o_orderkey % 5 = 0 then null else o_orderpriority end as queuename,
       case when o_orderkey % 7 = 0 then '' else 'u' || cast(o_custkey as string) end as username,
       case when o_orderkey % 11 = 0 then null else 'p' || cast(o_custkey % 20 as string) end as processid,
       '/tmp/' || cast(o_orderkey as string) as base_path
from {orders}""",
    "task_request_xml_v": """
select req_id, '<request><jobinstanceid>' || jobinstanceid || '</jobinstanceid><context>' ||
       coalesce('<property name="queueName" value="' || queuename || '"/>', '') ||
       '<property name="userName" value="' || username || '"/>' ||
       coalesce('<property name="processId" value="' || processid || '"/>', '') ||
       '<property name="tempHdfsBasePath" value="' || base_path || '"/></context></request>' as xml
from {task_request_v}""",
    "operator_doc_v": """
select req_id, case when version = 'v50' then null else opid end as opid,
       case when version = 'v48' then repeat('v', 65) else version end as version, biztype, provider,
       case when version = 'v49' then null else opjarpath end as opjarpath, descriptor,
       provider like '%2' as jar_first
from {operator_request_v}
union all
select req_id + 1000000, opid, version, biztype, provider, opjarpath, 'again', false
from {operator_request_v} where length(version) = 3""",
    "operator_xml_v": """
select req_id, opid, '<operator>' ||
       case when jar_first then coalesce('<property name="opjarpath" value="' || opjarpath || '"/>', '') else '' end ||
       coalesce('<property name="opid" value="' || opid || '"/>', '') ||
       '<property name="version" value="' || version || '"/>' ||
       '<property name="provider" value="' || provider || '"/>' ||
       '<property name="biztype" value="' || biztype || '"/>' ||
       case when jar_first then '' else coalesce('<property name="opjarpath" value="' || opjarpath || '"/>', '') end ||
       '<property name="descriptor" value="' || descriptor || '"/></operator>' as xml
from {operator_doc_v}""",
    "udf_doc_v": """
select p_partkey as req_id, case when p_size in (43, 50) then null else u.udfname end as udfname,
       case when p_size = 49 then null when p_size = 48 then repeat('c', 65) else 'com.fn.' || p_brand end as classname,
       case when p_size = 47 then null else 'fn.jar' end as jarname,
       case when p_size = 46 then repeat('d', 1025) when p_size = 45 then null else p_name end as descriptor,
       case when p_size in (43, 44) then null else p_type end as author
from {part} p join {udf_request_v} u on u.req_id = p.p_partkey""",
    "udf_xml_v": """
select req_id, '<request><udfdescriptor>' || coalesce('<udfname>' || udfname || '</udfname>', '') ||
       coalesce('<classname>' || classname || '</classname>', '') ||
       coalesce('<jarname>' || jarname || '</jarname>', '') ||
       coalesce('<descriptor>' || descriptor || '</descriptor>', '') ||
       coalesce('<author>' || author || '</author>', '') || '</udfdescriptor></request>' as xml
from {udf_doc_v}""",
    "quota_doc_v": """
select c_custkey as req_id, case when c_mktsegment = 'MACHINERY' then null when c_mktsegment = 'HOUSEHOLD' then 'xGB'
         else cast(cast(floor(abs(c_acctbal) / 100) as bigint) as string) || 'GB' end as quota
from {customer}""",
    "queue_doc_v": """
select c_custkey as req_id, case when c_mktsegment = 'MACHINERY' then null else 'q' || cast(c_custkey as string) end as name,
       case when c_acctbal < 0 then null else cast(cast(floor(c_acctbal * 10) as bigint) as string) end as memtotal,
       case when c_mktsegment = 'BUILDING' then null else cast(c_nationkey % 6 as string) || '.0' end as userlimitfactor
from {customer}""",
}


#: Views that Spark derives by a cheaper way to the same rows. Package entries: the many order lines of a part become one row
#: with a bit per kind of entry before they meet the requests, and an operator has one such row too; texts come last.
CHEAPER = {
    "package_entry_v": """
select opid, opid || '/' || case k when 1 then 'run.sh' when 2 then opid || '.jar' when 3 then 'description.xml'
         when 4 then 'ui.xml' when 5 then 'lib/Dshell2.5.0V2.jar' else 'lib/dep.jar' end as entry
from (
  select opid, explode(filter(array(1, 2, 3, 4, 5, 6), k -> getbit(kinds, k) = 1)) as k
  from (
    select r.opid, bit_or(p.kinds) as kinds
    from (select '/ops/' || cast(l_partkey as string) || '.zip' as path,
                 bit_or(shiftleft(1, case when l_linenumber between 1 and 5 then cast(l_linenumber as int) else 6 end)) as kinds
          from {lineitem} where l_quantity < 25 group by l_partkey) p
    join {operator_request_v} r on r.opjarpath = p.path group by r.opid) o) x""",
}


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{(\w+)}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a view derived from the test tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = CHEAPER.get(name) or VIEWS[name]
    return spark.sql(sql, **{r: table(spark, sf_dir, r) for r in references(sql)})


def ctes(*names: str) -> str:
    """``WITH`` list that defines the named views, and those they need, over the base tables."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE or name in done:
            return
        for ref in references(VIEWS[name]):
            add(ref)
        done[name] = VIEWS[name].format(**{r: r for r in references(VIEWS[name])})

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({body})" for n, body in done.items())


def append_to_files(pieces: DataFrame, root: str) -> None:
    """Append the bytes ``data`` to ``<root>/<file>``, in the order of ``at``; each file is one task's."""

    def write(batches):
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            name = out = None
            for file, data in zip(batch.column("file").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if file != name:
                    if out:
                        out.close()
                    name = file
                    system.create_dir(f"{base}/{file}".rpartition("/")[0])
                    out = system.open_append_stream(f"{base}/{file}")
                out.write(data)
            if out:
                out.close()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = pieces.repartition("file").sortWithinPartitions("file", "at").select("file", F.col("data").cast("binary").alias("data"))
    rows.mapInArrow(write, "n bigint").write.format("noop").mode("overwrite").save()
