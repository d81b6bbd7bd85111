"""Capacity, queue, storage and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtrail.operators import capacity as CP
from jobtrail.operators import storage as S
from jobtrail.plans import registration as R
from jobtrail.plans import validation as V
from jobtrail.plans.registry import Tables, query
from jobtrail.plans.request_queries import queues as queue_requests
from jobtrail.sources import documents as D

TOTAL = """
  total as (select cast(sum(g.memory_mb) as bigint) as memory_mb, cast(sum(g.vcores) as bigint) as vcores
            from role_v r join role_group_v g on g.group_name = r.group_name where r.type = 'NODEMANAGER')"""
CAPACITY_VIEWS = "role_v role_group_v"


def role_docs(t: Tables):
    """Role snapshots of at most 1000 roles each; the supplier key is unique, so the bound holds."""
    return t.role_v.groupBy(F.floor(F.col("pos") / 1000).alias("doc")).agg(F.sort_array(F.collect_list(F.struct(
        "pos", "name", "type", F.col("ha_status").alias("haStatus"),
        F.struct(F.col("group_name").alias("roleConfigGroupName")).alias("roleConfigGroupRef"),
    ))).alias("items")).select("doc", F.to_json(F.struct("items")).alias("json"))


def roles(t: Tables):
    return D.read_roles(role_docs(t))


def role_groups(t: Tables):
    docs = t.sql("""
      select to_json(named_struct('items', array(named_struct('name', group_name, 'roleType', 'NODEMANAGER', 'config',
        named_struct('items', array(
          named_struct('name', 'yarn_nodemanager_log_dirs', 'value', '/var/log'),
          named_struct('name', 'yarn_nodemanager_resource_memory_mb', 'value', cast(memory_mb as string)),
          named_struct('name', 'yarn_nodemanager_resource_cpu_vcores', 'value', cast(vcores as string)))))))) as json
      from {role_group_v}""")
    return D.read_role_groups(docs)


def scheduler(t: Tables):
    """One scheduler snapshot; its queues are the five order priorities, whatever the data size."""
    docs = t.sql("""
      select to_json(named_struct('scheduler', named_struct('schedulerInfo', named_struct('queues',
        named_struct('queue', collect_list(named_struct(
          'queueName', queue_name, 'capacity', cast(capacity as string), 'maxCapacity', cast(max_capacity as string),
          'userLimitFactor', cast(user_limit_factor as string), 'maxApplications', cast(max_applications as string),
          'numActiveApplications', cast(active_applications as string),
          'numPendingApplications', cast(pending_applications as string),
          'resourcesUsed', named_struct('memory', mem_used, 'vCores', vcores_used)))))))) as json
      from {queue_v}""")
    return D.read_scheduler(docs)


@query("a5_read_roles", "select cast(floor(pos / 1000) as bigint) as doc, name, type, ha_status, group_name from role_v",
       "role_v")
def a5_roles(t):
    return roles(t).drop("pos")


@query("a5_read_role_groups", """
select group_name, 'NODEMANAGER' as role_type, cast(memory_mb as integer) as memory_mb,
       cast(vcores as integer) as vcores from role_group_v""", "role_group_v")
def a5_groups(t):
    return role_groups(t)


@query("a5_read_scheduler", """
select queue_name, capacity, max_capacity, user_limit_factor, cast(max_applications as bigint) as max_applications,
       cast(active_applications as bigint) as active_applications,
       cast(pending_applications as bigint) as pending_applications, mem_used, vcores_used from queue_v""", "queue_v")
def a5_scheduler(t):
    return scheduler(t).drop("pos")


@query("d1_role_counts", """
select group_name, count(*) as n from role_v where type = 'NODEMANAGER' group by group_name""", "role_v")
def d1(t):
    return CP.role_counts(t.role_v)


@query("d2_group_capacity", """
select r.group_name, count(*) as n, cast(sum(g.memory_mb) as bigint) as memory_mb, cast(sum(g.vcores) as bigint) as vcores
from role_v r join role_group_v g on g.group_name = r.group_name where r.type = 'NODEMANAGER' group by r.group_name""",
       CAPACITY_VIEWS)
def d2(t):
    return CP.group_capacity(t.role_v, t.role_group_v)


@query("d3_finished_counts", """
select queue_name, sum(case when state = 'FINISHED' then 1 else 0 end)::bigint as n_finished
from queue_app_v group by queue_name""", "queue_app_v")
def d3(t):
    return CP.finished_counts(t.queue_app_v)


@query("c3_cluster_capacity", "select memory_mb, vcores from total", CAPACITY_VIEWS, TOTAL)
def c3(t):
    return CP.cluster_capacity(roles(t), role_groups(t))


@query("e5_active_master", """
, seen as (select group_name, case when ha_status = 'UNKNOWN' then 'UNKNOWN' else name end as master,
                  row_number() over (partition by group_name order by pos) rn
           from role_v where type = 'RESOURCEMANAGER' and ha_status in ('ACTIVE', 'UNKNOWN'))
select group_name, master from seen where rn = 1""", "role_v")
def e5(t):
    return CP.active_master(t.role_v, "group_name")


@query("c4_finished_per_queue", """
select q.queue_name, (select count(*) from queue_app_v a where a.queue_name = q.queue_name and a.state = 'FINISHED')
  as n_finished from queue_v q""", "queue_v queue_app_v")
def c4(t):
    return CP.finished_per_queue(t.queue_v, t.queue_app_v)


@query("j1_queue_report", """
, done as (select queue_name, count(*) filter (state = 'FINISHED') as n from queue_app_v group by queue_name),
  sized as (select q.*, coalesce(d.n, 0) as n,
      ceil(case when q.max_capacity < q.capacity * q.user_limit_factor then t.memory_mb
                else t.memory_mb * q.capacity * q.user_limit_factor / 100 end) as memtotal,
      ceil(t.vcores * q.capacity * q.user_limit_factor / 100) as cputotal
    from queue_v q cross join total t left join done d on d.queue_name = q.queue_name)
select queue_name as name, cast(max_applications as bigint) as maxapps, cast(active_applications as bigint) as numactiveapps,
       cast(pending_applications as bigint) as numpendingapps, cast(n as bigint) as numfinishedapps, 'capacity' as type,
       user_limit_factor as userlimitfactor, memtotal, mem_used as memused, memtotal - mem_used as memavail,
       cputotal, vcores_used as cpuused, cputotal - vcores_used as cpuavail from sized""",
       f"{CAPACITY_VIEWS} queue_v queue_app_v", TOTAL)
def j1(t):
    return CP.queue_report(scheduler(t), roles(t), role_groups(t), t.queue_app_v)


@query("j2_capacity_share", """
select q.req_id, floor(100 * (cast(q.memtotal as double) / t.memory_mb) + 0.5) as share
from queue_doc_v q cross join total t where q.memtotal is not null""", f"{CAPACITY_VIEWS} queue_doc_v", TOTAL)
def j2(t):
    total = CP.cluster_capacity(t.role_v, t.role_group_v).select("memory_mb").scalar()
    return t.queue_doc_v.filter("memtotal is not null").select(
        "req_id", CP.capacity_share(F.col("memtotal"), total).alias("share"))


def properties(t: Tables):
    """Scheduler properties, capacities set three times; the lowest priority plays the default queue."""
    docs = t.sql("""
      select '<configuration>' || head || case when name = 'default' then '30' else '9' end || tail ||
        head || case when name = 'default' then cast(capacity as string) else '100' end || tail ||
        head || case when name = 'default' then '100' else cast(capacity as string) end || tail ||
        '<property><name>yarn.scheduler.capacity.root.' || name || '.state</name><value>RUNNING' || tail ||
        '</configuration>' as xml
      from (select name, capacity, '</value></property>' as tail,
              '<property><name>yarn.scheduler.capacity.root.' || name || '.capacity</name><value>' as head
            from (select case when queue_name = '5-LOW' then 'default' else queue_name end as name, capacity
                  from {queue_v}))""")
    return D.read_properties(docs)


def wanted(t: Tables):
    # 5-LOW here names no configured queue: the default queue took its place.
    return V.validate_queues(queue_requests(t)).filter("error = ''").join(
        t.sql("select o_custkey as req_id, max(o_orderpriority) as queue_name from {orders} group by o_custkey"), "req_id")


ADMISSION = TOTAL + """,
  wanted as (select d.req_id, d.memtotal, coalesce(d.userlimitfactor, '1.0') as userlimitfactor, o.queue_name
             from queue_doc_v d join (select o_custkey, max(o_orderpriority) as queue_name from orders group by o_custkey) o
               on o.o_custkey = d.req_id where d.name is not null and d.memtotal is not null),
  shares as (select w.*, floor(100 * (cast(w.memtotal as double) / t.memory_mb) + 0.5) as share
             from wanted w cross join total t)"""


@query("j3_admission_create", """
select req_id, share, 20.0::double - share as default_left, 20.0::double - share >= 0 as admitted,
       case when share * cast(userlimitfactor as double) < 100 then share * cast(userlimitfactor as double)
            else 100.0::double end as max_capacity from shares""", f"{CAPACITY_VIEWS} queue_doc_v", ADMISSION)
def j3(t):
    total = CP.cluster_capacity(t.role_v, t.role_group_v).select("memory_mb").scalar()
    return CP.admission(wanted(t), properties(t), total).select(
        "req_id", "share", "default_left", "admitted", "max_capacity")


@query("j3_admission_update", """
select req_id, share, 20.0::double - (case when queue_name = '5-LOW' then 0 else share - 20 end) as default_left,
       20.0::double - (case when queue_name = '5-LOW' then 0 else share - 20 end) >= 0 as admitted from shares""",
       f"{CAPACITY_VIEWS} queue_doc_v", ADMISSION)
def j3_update(t):
    total = CP.cluster_capacity(t.role_v, t.role_group_v).select("memory_mb").scalar()
    return CP.admission(wanted(t), properties(t), total, update=True).select(
        "req_id", "share", "default_left", "admitted")


QUEUE_REQUESTS = TOTAL + """,
  asked as (select d.req_id, case when d.name is null then null when d.req_id % 3 = 0 then o.queue_name else d.name end as name,
                   d.memtotal from queue_doc_v d left join (
                     select o_custkey, max(o_orderpriority) as queue_name from orders group by o_custkey) o
                   on o.o_custkey = d.req_id),
  known as (select case when queue_name = '5-LOW' then 'default' else queue_name end as queue_name from queue_v),
  judged as (select a.req_id, a.name, a.memtotal, k.queue_name is not null as exists_already,
                    floor(100 * (cast(a.memtotal as double) / t.memory_mb) + 0.5) as share
             from asked a cross join total t left join known k on k.queue_name = a.name)"""


def queue_batch(t: Tables):
    """Validated queue requests of which every third names the queue its customer uses most."""
    requests = queue_requests(t).join(
        t.sql("select o_custkey as req_id, max(o_orderpriority) as busy from {orders} group by o_custkey"), "req_id", "left")
    name = F.when(F.col("name").isNotNull(), F.when(F.col("req_id") % 3 == 0, F.col("busy")).otherwise(F.col("name")))
    return V.validate_queues(requests.withColumn("name", name)).drop("busy")


@query("j3_judge_new_queues", """
select req_id, case when memtotal is null then 'memtotal is not exist' when name is null then 'queueName is not exist'
    when exists_already then 'exist queue: ' || name when 20 - share < 0 then 'The cluster does not have enough memory resource'
    else '' end as reason from judged""", f"{CAPACITY_VIEWS} queue_v queue_doc_v", QUEUE_REQUESTS)
def j3_new(t):
    total = CP.cluster_capacity(t.role_v, t.role_group_v).select("memory_mb").scalar()
    known = CP.queue_settings(properties(t)).select("queue_name").distinct()
    return R.judge_queues(queue_batch(t), known, properties(t), total).select("req_id", "reason")


@query("j3_judge_queue_updates", """
select req_id, case when memtotal is null then 'memtotal is not exist' when name is null then 'queueName is not exist'
    when not exists_already then 'not exist queue: ' || name when 20 - (share - 20) < 0
    then 'The cluster does not have enough memory resource' else '' end as reason
from judged""", f"{CAPACITY_VIEWS} queue_v queue_doc_v", QUEUE_REQUESTS)
def j3_judge_update(t):
    total = CP.cluster_capacity(t.role_v, t.role_group_v).select("memory_mb").scalar()
    known = CP.queue_settings(properties(t)).select("queue_name").distinct()
    return R.judge_queues(queue_batch(t), known, properties(t), total, update=True).select("req_id", "reason")


@query("c10_queue_drift", """
, req as (select c_custkey, cast(c_nationkey as double) as capacity, 1.0::double as ulf from customer),
  obs as (select o_custkey, cast(count(*) as double) as capacity, cast(max(o_orderkey % 2) as double) as ulf
          from orders group by o_custkey)
select 'q' || c_custkey as queue_name, 'capacity' as setting, r.capacity as requested, o.capacity as observed
from req r join obs o on o.o_custkey = r.c_custkey where r.capacity <> o.capacity
union all
select 'q' || c_custkey, 'user_limit_factor', r.ulf, o.ulf
from req r join obs o on o.o_custkey = r.c_custkey where r.ulf <> o.ulf""".replace(", req", "with req", 1))
def c10(t):
    requested = t.sql("""select 'q' || c_custkey as queue_name, cast(c_nationkey as double) as capacity,
                                cast(1 as double) as user_limit_factor from {customer}""")
    observed = t.sql("""select 'q' || o_custkey as queue_name, cast(count(*) as double) as capacity,
                               cast(max(o_orderkey % 2) as double) as user_limit_factor from {orders} group by o_custkey""")
    return CP.queue_drift(requested, observed)


@query("d4_storage_usage", """
, used as (select group_name, cast(sum(size_bytes) as bigint) as used_bytes, count(*) as n_files from file_v group by group_name)
select group_name, used_bytes, n_files,
       case when group_name in ('click', 'signup', 'view') then n_files * 5000 else -1 end as quota_bytes,
       coalesce(used_bytes > case when group_name in ('click', 'signup', 'view') then n_files * 5000 end, false) as over_quota
from used""", "file_v")
def d4(t):
    quotas = t.sql("""select group_name, count(*) * 5000 as quota_bytes from {file_v}
                      where group_name in ('click', 'signup', 'view') group by group_name""")
    files = S.with_group(t.file_v.drop("group_name"), "/user/department/")
    return S.storage_usage(files, quotas).withColumn("quota_bytes", F.coalesce("quota_bytes", F.lit(-1)))


@query("k1_expired_files", "select path, size_bytes from file_v where mtime < timestamp '2024-01-20 12:00:00'", "file_v")
def k1_expired(t):
    return S.split_expired(t.file_v, "2024-01-25 12:00:00")[0].select("path", "size_bytes")


@query("k1_kept_files", "select path, size_bytes from file_v where mtime >= timestamp '2024-01-22 12:00:00'", "file_v")
def k1_kept(t):
    return S.split_expired(t.file_v, "2024-01-25 12:00:00", days=3)[1].select("path", "size_bytes")
