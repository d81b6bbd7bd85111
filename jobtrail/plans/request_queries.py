"""Request documents, validation rules, packages, registration and the function registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtrail import constants as C
from jobtrail.operators import keys as K
from jobtrail.operators import packages as PK
from jobtrail.operators import registry as G
from jobtrail.plans import registration as R
from jobtrail.plans import validation as V
from jobtrail.plans.registry import Tables, query
from jobtrail.session import scratch_path
from jobtrail.sources import documents as D


def blank(*names: str):
    """Columns with NULL shown as an empty text, so both engines print them alike."""
    return [F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]


def tasks(t: Tables):
    return V.validate_tasks(D.parse_requests(t.task_request_xml_v, "task"))


def operators(t: Tables, update: bool = False):
    # An update names its operator beside the document; request numbers repeat, so they are no key to join it by.
    docs = t.operator_xml_v if update else t.operator_xml_v.drop("opid")
    return V.validate_operators(D.parse_requests(docs, "operator"), t.package_path_v, update=update)


def udfs(t: Tables):
    return V.validate_udfs(D.parse_requests(t.udf_xml_v, "udf"))


@query("a3_task_requests", """
select req_id, jobinstanceid, coalesce(queuename, 'default') as queuename, username,
       coalesce(processid, '') as processid, base_path from task_request_v""", "task_request_v")
def a3_tasks(t):
    return tasks(t).select("req_id", "jobinstanceid", "queuename", "username", *blank("processid"), "base_path")


@query("a3_operator_requests", """
select req_id, coalesce(opid, '') as opid, version, provider, biztype, coalesce(opjarpath, '') as opjarpath,
       descriptor from operator_doc_v""", "operator_doc_v")
def a3_operators(t):
    return operators(t).select("req_id", *blank("opid"), "version", "provider", "biztype", *blank("opjarpath"),
                               "descriptor")


@query("a3_queue_requests", """
select req_id, coalesce(name, '') as name, coalesce(memtotal, '') as memtotal,
       coalesce(userlimitfactor, '1.0') as userlimitfactor from queue_doc_v""", "queue_doc_v")
def a3_queues(t):
    return V.validate_queues(queues(t)).select("req_id", *blank("name", "memtotal"), "userlimitfactor")


def queues(t: Tables):
    xml = t.sql("""
      select req_id, '<queuedesc>' || coalesce('<name>' || name || '</name>', '') || '<calcresource>' ||
        coalesce('<memtotal>' || memtotal || '</memtotal>', '') ||
        coalesce('<userlimitfactor>' || userlimitfactor || '</userlimitfactor>', '') ||
        '</calcresource></queuedesc>' as xml from {queue_doc_v}""")
    return D.parse_requests(xml, "queue").drop("xml")


@query("a3_request_files", """
select jobinstanceid, coalesce(queuename, 'default') as queuename, username, coalesce(processid, '') as processid,
       base_path from task_request_v""", "task_request_v")
def a3_files(t):
    path = scratch_path(t.spark, "requests")
    t.sql("""
      select jobinstanceid, named_struct('property', filter(array(
          named_struct('_name', 'queueName', '_value', queuename), named_struct('_name', 'userName', '_value', username),
          named_struct('_name', 'processId', '_value', processid),
          named_struct('_name', 'tempHdfsBasePath', '_value', base_path)), p -> p._value is not null)) as context
      from {task_request_v}""").write.format("xml").option("rootTag", "requests").option("rowTag", "request").save(path)
    judged = V.validate_tasks(D.read_requests(t.spark, path, "task", "request"))
    return judged.select("jobinstanceid", "queuename", "username", *blank("processid"), "base_path")


@query("a4_read_properties", """
select c_custkey, 0 as pos, 'yarn.scheduler.capacity.root.q' || c_custkey || '.capacity' as name,
       cast(c_nationkey as varchar) as value from customer
union all
select c_custkey, 1, 'yarn.scheduler.capacity.root.q' || c_custkey || '.state', c_mktsegment from customer""")
def a4(t):
    return D.read_properties(t.sql("""
      select c_custkey, '<configuration><property><name>yarn.scheduler.capacity.root.q' || c_custkey ||
        '.capacity</name><value>' || c_nationkey || '</value></property><property><name>' ||
        'yarn.scheduler.capacity.root.q' || c_custkey || '.state</name><value>' || c_mktsegment ||
        '</value></property></configuration>' as xml from {customer}"""))


TASK_ERROR = """
  judged as (select req_id,
    case when processid is null then 'the ProcessId is null'
         when username = '' then 'the property userName is null'
         when length(jobinstanceid) > 128 then 'jobInstanceId长度不能大于128' else '' end as error,
    cast(case when processid is null then 1 else 0 end + case when username = '' then 1 else 0 end +
      case when length(jobinstanceid) > 128 then 1 else 0 end as integer) as n_errors from task_request_v)"""


@query("i1_validate_tasks", "select * from judged", "task_request_v", TASK_ERROR)
def i1(t):
    return tasks(t).select("req_id", "error", F.size("errors").alias("n_errors"))


OPERATOR_RULES = """
  broken as (select d.*,
    case when d.opid = '' then 'opid is null' when d.opid like '% %' then 'operator name contains space'
         when strpos(d.opid, '.') = 0 then 'operator name should contains ''.'''
         when split_part(d.opid, '.', 1) not in ('GM', 'SK', 'MR', 'HV')
           then 'operator name should begin with GM,SK,MR,HV' end as e_opid,
    case when d.opjarpath = '' then 'opjarpath is null'
         when d.opjarpath is not null and p.path is null then 'the hdfs zip(' || d.opjarpath || ') is not exist' end as e_jar,
    case when d.opid is null then 'opid is null' end as m_opid,
    case when d.opjarpath is null then 'opjarpath is null' end as m_jar,
    case when length(d.opid) > 64 then 'opid长度不能大于64' when length(d.version) > 64 then 'version长度不能大于64'
         when length(d.descriptor) > 1024 then 'descriptor长度不能大于1024' else '' end as error_length
    from operator_doc_v d left join package_path_v p on p.path = d.opjarpath),
  judged as (select req_id, opid, error_length,
    case when jar_first then coalesce(e_jar, e_opid, m_opid, m_jar, '')
         else coalesce(e_opid, e_jar, m_opid, m_jar, '') end as error,
    coalesce(e_jar, m_jar, '') as error_update,
    cast((e_opid is not null)::int + (e_jar is not null)::int + (m_opid is not null)::int +
         (m_jar is not null)::int as integer) as n_errors, version, provider, opjarpath, descriptor from broken)"""


@query("i2_validate_operators", "select req_id, error, error_length, n_errors from judged",
       "operator_doc_v package_path_v", OPERATOR_RULES)
def i2(t):
    return operators(t).select("req_id", "error", "error_length", F.size("errors").alias("n_errors"))


UDF_RULES = """
  judged as (select req_id, udfname,
    case when author is null then 'author is null' when descriptor is null then 'descriptor is null'
         when jarname is null then 'jarname is null' when classname is null then 'classname is null'
         when udfname is null then 'udfname is null' else '' end as error,
    case when length(udfname) > 64 then 'udfname长度不能大于64'
         when length(classname) > 64 then 'classname长度不能大于64'
         when length(descriptor) > 1024 then 'descriptor长度不能大于1024' else '' end as error_length
    from udf_doc_v)"""


@query("i3_validate_udfs", "select req_id, error, error_length from judged", "udf_doc_v", UDF_RULES)
def i3(t):
    return udfs(t).select("req_id", "error", "error_length")


UDF_UPDATE_RULES = """
  updates as (select req_id, coalesce(udfname, '') as udfname, descriptor,
    case when descriptor is null then 'descriptor is null'
         when length(descriptor) > 1024 then 'descriptor长度不能大于1024' else '' end as error from udf_doc_v)"""


def udf_updates(t: Tables):
    xml = t.sql("""
      select req_id, coalesce(udfname, '') as udfname,
             '<request>' || coalesce('<descriptor>' || descriptor || '</descriptor>', '') || '</request>' as xml
      from {udf_doc_v}""")
    return V.validate_udf_updates(D.parse_requests(xml, "udf_update"))


@query("i4_validate_udf_updates", "select req_id, error from updates", "udf_doc_v", UDF_UPDATE_RULES)
def i4(t):
    return udf_updates(t).select("req_id", "error")


@query("i5_validate_quotas", """
, parsed as (select req_id, quota, try_cast(replace(quota, 'GB', '') as bigint) as gb from quota_doc_v)
select req_id, case when quota is null then 'quota is null' when gb is null then 'quota is not a number'
                    when gb > 50 then 'quota can not larger than 53687091200' else '' end as error,
       case when gb <= 50 then gb * 1073741824 else -1 end as quota_bytes from parsed""", "quota_doc_v")
def i5(t):
    xml = t.sql("""select req_id, '<request>' || coalesce('<quota>' || quota || '</quota>', '') || '</request>' as xml
                   from {quota_doc_v}""")
    judged = V.validate_quotas(D.parse_requests(xml, "quota"))
    return judged.select("req_id", "error", F.coalesce("quota_bytes", F.lit(-1)).alias("quota_bytes"))


@query("i6_validate_queues", """
select req_id, case when memtotal is null then 'memtotal is not exist'
                    when name is null then 'queueName is not exist' else '' end as error from queue_doc_v""",
       "queue_doc_v")
def i6(t):
    return V.validate_queues(queues(t)).select("req_id", "error")


PACKAGES = """
  required as (select distinct opid, unnest([opid || '/run.sh', opid || '/' || opid || '.jar',
                 opid || '/description.xml', opid || '/ui.xml']) as entry from operator_request_v),
  packages as (select r.opid, count(e.entry) = 4 as complete, 4 - count(e.entry) as n_missing
               from required r left join package_entry_v e on e.opid = r.opid and e.entry = r.entry group by r.opid)"""
SUBMITS = """
  submits as (select o.opid,
      exists (select 1 from package_entry_v e where e.opid = o.opid and e.entry like '%Dshell2.5.0V2.jar') as ships_jar,
      exists (select 1 from script_line_v s where s.opid = o.opid and s.line like '%Dshell2.5.0V2.jar%'
              and ltrim(s.line) not like '#%') as uses_jar
    from (select distinct opid from operator_request_v where opid like 'GM.%') o)"""


@query("d5_package_check", "select opid, complete, cast(n_missing as integer) as n_missing from packages",
       "operator_request_v package_entry_v", PACKAGES)
def d5(t):
    return PK.package_check(t.package_entry_v, t.operator_request_v).select(
        "opid", "complete", F.size("missing").alias("n_missing"))


@query("g3_missing_entries", """
select opid, entry from required except select opid, entry from package_entry_v""",
       "operator_request_v package_entry_v", PACKAGES)
def g3(t):
    # One row of flags per operator; names become texts only where an entry is missing.
    checked = PK.package_check(t.package_entry_v, t.operator_request_v)
    return checked.select("opid", F.explode("missing").alias("name")).select(
        "opid", F.concat("opid", F.lit("/"), F.replace("name", F.lit("<opid>"), F.col("opid"))).alias("entry"))


@query("b12_script_uses", """
select opid, bool_or(line like '%Dshell2.5.0V2.jar%' and left(ltrim(line), 1) <> '#') as uses
from script_line_v group by opid""", "script_line_v")
def b12(t):
    return PK.script_uses(t.script_line_v, C.SUBMIT_JAR)


@query("d6_submit_jar_check", "select opid, ships_jar, uses_jar, ships_jar and uses_jar as submits from submits",
       "operator_request_v package_entry_v script_line_v", SUBMITS)
def d6(t):
    return PK.submit_jar_check(t.package_entry_v, t.script_line_v, t.operator_request_v)


@query("c7_stale_packages", """
select 'SK.op' || p.p_partkey as opid, s.s_suppkey is null or p.p_size % 3 <> s.s_nationkey % 3 as stale
from part p left join supplier s on s.s_suppkey = p.p_partkey""")
def c7(t):
    published = t.sql("select 'SK.op' || p_partkey as opid, 'v' || p_size % 3 as checksum from {part}")
    local = t.sql("select 'SK.op' || s_suppkey as opid, 'v' || s_nationkey % 3 as checksum from {supplier}")
    return PK.stale_packages(local, published).select("opid", "stale")


REGISTRATION = f"""{OPERATOR_RULES}, {PACKAGES}, {SUBMITS},
  checked as (select j.*, exists (select 1 from operator_v o where o.opid = j.opid) as known,
      case when not coalesce(p.complete, false) then 'The ZIP file of ''' || j.opid || ''' in HDFS  is not completed .'
           when j.opid like 'GM.%' and not (s.ships_jar and s.uses_jar)
             then '该单机算子需要使用DShell提交到YARN执行' else '' end as package
    from judged j left join packages p on p.opid = j.opid left join submits s on s.opid = j.opid),
  clean as (select opid, min(req_id) as first from checked
            where error = '' and not known and package = '' and error_length = '' group by opid)"""
REGISTRATION_VIEWS = "operator_doc_v package_path_v operator_v package_entry_v script_line_v"


def registration(t: Tables):
    return R.register_operators(operators(t), t.operator_v, t.package_entry_v, t.script_line_v, "req_id")


@query("i7_register_operators", """
select k.req_id, coalesce(k.opid, '') as opid,
       case when k.error <> '' then k.error
            when k.known or k.req_id > c.first then 'the opid ''' || k.opid || ''' is exist'
            when k.package <> '' then k.package else k.error_length end as reason
from checked k left join clean c on c.opid = k.opid""", REGISTRATION_VIEWS, REGISTRATION)
def i7(t):
    return registration(t).select("req_id", *blank("opid"), "reason")


@query("a7_append_operators", """
select opid, version, provider from operator_v
union all
select k.opid, k.version, k.provider from checked k join clean c on c.opid = k.opid and c.first = k.req_id""",
       REGISTRATION_VIEWS, REGISTRATION)
def a7(t):
    cols = ["opid", "version", "provider"]
    return t.operator_v.select(*cols).unionByName(R.accepted(registration(t)).select(*cols))


UPDATES = f"""{REGISTRATION},
  refused as (select req_id, coalesce(opid, '') as opid, version, descriptor,
      case when opid is null or not known then 'the opid ''' || coalesce(opid, '') || ''' is not exist'
           when error_update <> '' then error_update when package <> '' then package else error_length end as reason
    from checked),
  winners as (select *, row_number() over (partition by opid order by req_id desc) rn from refused where reason = '')"""


def updates(t: Tables):
    requests = operators(t, update=True).withColumn("opid", F.coalesce("opid", F.lit("")))
    return R.judge_operator_updates(requests, t.operator_v, t.package_entry_v, t.script_line_v)


@query("i9_judge_operator_updates", "select req_id, opid, reason from refused", REGISTRATION_VIEWS, UPDATES)
def i9(t):
    return updates(t).select("req_id", "opid", "reason")


@query("i9_updated_operators", """
select o.opid, coalesce(w.version, o.version) as version, coalesce(w.descriptor, o.descriptor) as descriptor
from operator_v o left join winners w on w.opid = o.opid and w.rn = 1""", REGISTRATION_VIEWS, UPDATES)
def i9_updated(t):
    return R.update_operators(t.operator_v, updates(t), ["version", "descriptor"], "req_id").select(
        "opid", "version", "descriptor")


@query("i9_judge_operator_deletes", """
select s_suppkey, 'GM.op' || s_suppkey as opid,
       case when 'GM.op' || s_suppkey in (select opid from operator_v) then ''
            else 'the opid ''GM.op' || s_suppkey || ''' is not exist' end as reason from supplier""", "operator_v")
def i9_deletes(t):
    wanted = t.sql("select s_suppkey, 'GM.op' || s_suppkey as opid from {supplier}")
    return R.judge_deletes(wanted, t.operator_v, "opid", C.OPID_UNKNOWN).select("s_suppkey", "opid", "reason")


@query("i9_deleted_operators", """
select opid, version from operator_v where opid not in (select 'GM.op' || s_suppkey from supplier)""", "operator_v")
def i9_deleted(t):
    wanted = t.sql("select 'GM.op' || s_suppkey as opid from {supplier}")
    judged = R.judge_deletes(wanted, t.operator_v, "opid", C.OPID_UNKNOWN)
    return R.delete_registered(t.operator_v, judged, "opid").select("opid", "version")


SYSTEM = "system as (select unnest([{}]) as name)".format(
    ", ".join("'" + n + "'" for n in C.SYSTEM_FUNCTIONS))
CONFLICTS = SYSTEM + """,
  conflicts as (select r.req_id, lower(r.udfname) as name,
      case when lower(r.udfname) in (select name from system) then 'system'
           when lower(r.udfname) in (select udfname from udf_v) then 'registered'
           when lower(r.udfname) in (select func_name from funcs_v) then 'metastore' else '' end as conflict
    from udf_request_v r)"""


@query("c2_udf_conflicts", "select req_id, name, conflict from conflicts", "udf_request_v udf_v funcs_v", CONFLICTS)
def c2(t):
    return R.udf_conflicts(t.udf_request_v, t.udf_v, t.funcs_v).select("req_id", "name", "conflict")


UDF_REGISTRATION = f"""{CONFLICTS}, {UDF_RULES},
  checked as (select j.req_id, coalesce(lower(j.udfname), '') as name, j.error, j.error_length,
                     case when j.udfname is null then '' else c.conflict end as conflict
              from judged j join conflicts c on c.req_id = j.req_id),
  clean as (select name, min(req_id) as first from checked
            where error = '' and conflict = '' and error_length = '' group by name)"""
UDF_VIEWS = "udf_request_v udf_v funcs_v udf_doc_v"


@query("i8_register_udfs", """
select k.req_id, k.name, case when k.error <> '' then k.error
    when k.conflict = 'system' then 'thd udfname ''' || k.name || ''' is system function, please use a different name.'
    when k.conflict = 'registered' or k.req_id > c.first then 'thd udfname ''' || k.name || ''' is exist, please use a different name.'
    when k.conflict = 'metastore' then 'thd udfname ''' || k.name || ''' is exist in HiveMetaStore, please use a different name.'
    else k.error_length end as reason
from checked k left join clean c on c.name = k.name""", UDF_VIEWS, UDF_REGISTRATION)
def i8(t):
    return R.register_udfs(udfs(t), t.udf_v, t.funcs_v, "req_id").select("req_id", *blank("name"), "reason")


@query("m1_registry_after_batch", """
select udfname from udf_v union all select name from clean""", UDF_VIEWS, UDF_REGISTRATION)
def m1(t):
    judged = R.register_udfs(udfs(t), t.udf_v, t.funcs_v, "req_id")
    return t.udf_v.select("udfname").unionByName(R.accepted(judged).select(F.col("name").alias("udfname")))


@query("m1_udf_updates", """
select req_id, lower(udfname) as udfname, case when error <> '' then error
    when lower(udfname) in (select udfname from udf_v) then ''
    else 'thd udfname ''' || lower(udfname) || ''' is not exist' end as reason from updates""",
       "udf_doc_v udf_v", UDF_UPDATE_RULES)
def m1_updates(t):
    return R.judge_udf_updates(udf_updates(t), t.udf_v).select("req_id", "udfname", "reason")


@query("m1_udf_deletes", """
select req_id, lower(udfname) as udfname, case when lower(udfname) in (select udfname from udf_v) then ''
    else 'thd udfname ''' || lower(udfname) || ''' is not exist.' end as reason from udf_request_v""",
       "udf_request_v udf_v")
def m1_deletes(t):
    wanted = t.udf_request_v.select("req_id", F.lower("udfname").alias("udfname"))
    return R.judge_deletes(wanted, t.udf_v, "udfname", C.UDF_UNKNOWN_DELETE).select("req_id", "udfname", "reason")


@query("m1_udf_details", """
select d.req_id, lower(d.udfname) as udfname, d.jarname from udf_doc_v d
where lower(d.udfname) in (select udfname from udf_v) and d.jarname is not null""", "udf_doc_v udf_v")
def m1_details(t):
    details = t.udf_doc_v.withColumn("udfname", F.lower("udfname")).filter(F.col("jarname").isNotNull())
    return K.fetch(details, t.udf_v, "udfname", ["req_id", "udfname", "jarname"])


# What a name is before an event: the last registration or deletion before it decides, else the registry.
EVENTS = """
  was as (
    select e.*, coalesce(last_value(case when error <> '' then null when kind = 'register' then true when kind = 'delete' then false end
                                    ignore nulls) over (partition by e.udfname order by req_id rows between unbounded preceding and 1 preceding),
                         r.udfname is not null) as present
    from udf_event_v e left join udf_registry_v r on r.udfname = e.udfname where {kinds}),
  told as (
    select *, case when error <> '' then error when kind = 'register' and present
                     then 'thd udfname ''' || udfname || ''' is exist, please use a different name.'
                   when kind = 'update' and not present then 'thd udfname ''' || udfname || ''' is not exist'
                   when kind = 'delete' and not present then 'thd udfname ''' || udfname || ''' is not exist.' else '' end as reason
    from was),
  last as (
    select udfname, arg_max(kind <> 'delete', req_id) filter (where kind <> 'update') as present,
           arg_max(descriptor, req_id) filter (where kind <> 'delete') as descriptor,
           arg_max(author, req_id) filter (where kind = 'register') as author
    from told where reason = '' group by udfname)"""
REGISTRY = """
select coalesce(l.udfname, r.udfname) as udfname, coalesce(l.descriptor, r.descriptor) as descriptor, coalesce(l.author, r.author) as author
from udf_registry_v r full join last l on l.udfname = r.udfname where coalesce(l.present, true)"""
EVENT_VIEWS = "udf_event_v udf_registry_v"
ALL_KINDS, UPDATES, DELETES = (EVENTS.format(kinds=k) for k in ("true", "kind = 'update'", "kind = 'delete'"))


def judged_events(t: Tables, *kinds: str):
    events = t.udf_event_v.filter(F.col("kind").isin(*kinds)) if kinds else t.udf_event_v
    messages = {G.REGISTER: C.UDF_EXISTS, G.UPDATE: C.UDF_UNKNOWN_UPDATE, G.DELETE: C.UDF_UNKNOWN_DELETE}
    return G.judge_events(events, t.udf_registry_v, "udfname", "req_id", messages)


def registry_of(t: Tables, *kinds: str):
    return G.registry_after(judged_events(t, *kinds), t.udf_registry_v, "udfname", ["descriptor"], ["author"])


@query("m1_mixed_batch", "select req_id, udfname, kind, reason from told", EVENT_VIEWS, ALL_KINDS)
def m1_mixed(t):
    return judged_events(t).select("req_id", "udfname", "kind", "reason")


@query("m1_mixed_registry", REGISTRY, EVENT_VIEWS, ALL_KINDS)
def m1_mixed_registry(t):
    return registry_of(t)


@query("m1_updated_registry", REGISTRY, EVENT_VIEWS, UPDATES)
def m1_updated(t):
    return registry_of(t, G.UPDATE)


@query("m1_deleted_registry", REGISTRY, EVENT_VIEWS, DELETES)
def m1_deleted(t):
    return registry_of(t, G.DELETE)
