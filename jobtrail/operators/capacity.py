"""Cluster capacity, per-queue reports, capacity shares and admission of queue requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C


def role_counts(roles: DataFrame, role_type: str = C.NODE_ROLE) -> DataFrame:
    return roles.filter(F.col("type") == role_type).groupBy("group_name").agg(F.count("*").alias("n"))


def group_capacity(roles: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes of each configuration group and what they add up to."""
    if "role_type" in groups.columns:
        groups = groups.filter(F.col("role_type") == C.NODE_ROLE)
    return groups.join(role_counts(roles), "group_name").select(
        "group_name", "n",
        (F.col("n") * F.col("memory_mb")).cast("bigint").alias("memory_mb"),
        (F.col("n") * F.col("vcores")).cast("bigint").alias("vcores"),
    )


def cluster_capacity(roles: DataFrame, groups: DataFrame) -> DataFrame:
    """Total memory and vcores of all nodes, one row; a group without nodes adds nothing."""
    return group_capacity(roles, groups).agg(
        F.coalesce(F.sum("memory_mb"), F.lit(0)).cast("bigint").alias("memory_mb"),
        F.coalesce(F.sum("vcores"), F.lit(0)).cast("bigint").alias("vcores"),
    )


def active_master(roles: DataFrame, cluster: str) -> DataFrame:
    """First master by position that is ACTIVE, or UNKNOWN if one in that state comes before it."""
    seen = roles.filter((F.col("type") == C.MASTER_ROLE) & F.col("ha_status").isin("UNKNOWN", "ACTIVE"))
    result = F.when(F.col("ha_status") == "UNKNOWN", "UNKNOWN").otherwise(F.col("name"))
    return seen.groupBy(cluster).agg(F.min_by(result, F.col("pos")).alias("master"))


def finished_counts(apps: DataFrame) -> DataFrame:
    return apps.groupBy("queue_name").agg(F.count_if(F.col("state") == C.FINISHED).alias("n_finished"))


def finished_per_queue(queues: DataFrame, apps: DataFrame) -> DataFrame:
    """Finished applications of each queue, 0 where it has none; applications aggregate first."""
    return queues.select("queue_name").join(finished_counts(apps), "queue_name", "left").select(
        "queue_name", F.coalesce("n_finished", F.lit(0)).alias("n_finished"))


def queue_report(queues: DataFrame, roles: DataFrame, groups: DataFrame, apps: DataFrame) -> DataFrame:
    """Use and headroom of every queue. Cluster totals are computed once, in a scalar subquery."""
    total = cluster_capacity(roles, groups).select(F.struct("memory_mb", "vcores")).scalar()
    memory, vcores = total["memory_mb"], total["vcores"]
    share = F.col("capacity") * F.col("user_limit_factor")
    mem_total = F.ceil(
        F.when(F.col("max_capacity") < share, memory.cast("double"))
        .otherwise(memory * F.col("capacity") * F.col("user_limit_factor") / 100)
    ).cast("double")
    cpu_total = F.ceil(vcores * F.col("capacity") * F.col("user_limit_factor") / 100).cast("double")
    return (
        queues.join(finished_counts(apps), "queue_name", "left")
        .withColumn("n_finished", F.coalesce("n_finished", F.lit(0)))
        .withColumns({"mem_total": mem_total, "cpu_total": cpu_total})
        .select(
            F.col("queue_name").alias("name"), F.col("max_applications").alias("maxapps"),
            F.col("active_applications").alias("numactiveapps"),
            F.col("pending_applications").alias("numpendingapps"),
            F.col("n_finished").alias("numfinishedapps"), F.lit("capacity").alias("type"),
            F.col("user_limit_factor").alias("userlimitfactor"),
            F.col("mem_total").alias("memtotal"), F.col("mem_used").alias("memused"),
            (F.col("mem_total") - F.col("mem_used")).alias("memavail"),
            F.col("cpu_total").alias("cputotal"), F.col("vcores_used").alias("cpuused"),
            (F.col("cpu_total") - F.col("vcores_used")).alias("cpuavail"),
        )
    )


def capacity_share(requested: Column, total: Column) -> Column:
    """Whole percent of the cluster, halves rounded up."""
    return F.floor(100 * (requested.cast("double") / total.cast("double")) + 0.5).cast("double")


def queue_settings(properties: DataFrame) -> DataFrame:
    """(queue_name, setting, pos, value) from scheduler (pos, name, value) properties."""
    pattern = "^" + C.QUEUE_PROPERTY_PREFIX.replace(".", "\\.") + r"(.+)\.([^.]+)$"
    return (
        properties.filter(F.col("name").rlike(pattern))
        .select(F.regexp_extract("name", pattern, 1).alias("queue_name"),
                F.regexp_extract("name", pattern, 2).alias("setting"), "pos", "value")
    )


def admission(requests: DataFrame, properties: DataFrame, total_memory: Column, update: bool = False) -> DataFrame:
    """Can the default queue pay for each request, judged independently of the others.

    ``requests`` has (queue_name, memtotal, userlimitfactor); a new queue takes its share from
    the default queue, an update only the difference to its present capacity. Where a capacity
    is set repeatedly, the least one of the default queue and the last one of any other counts.
    """
    settings = queue_settings(properties).filter(F.col("setting") == "capacity").select(
        "queue_name", "pos", F.col("value").try_cast("double").alias("_value"))
    capacities = settings.groupBy("queue_name").agg(F.max_by("_value", "pos").alias("_capacity"))
    default = settings.filter(F.col("queue_name") == C.DEFAULT_QUEUE).agg(F.min("_value")).scalar()
    share = capacity_share(F.col("memtotal").try_cast("double"), total_memory)
    df = requests.withColumn("share", share)
    if update:
        df = df.join(capacities, "queue_name", "left")
        change = F.coalesce(F.col("share") - F.col("_capacity"), F.lit(0.0))
    else:
        change = F.col("share")
    df = df.withColumn("default_left", default - change)
    df = df.withColumn("admitted", F.col("default_left") >= 0)
    if update:
        return df.drop("_capacity")
    factor = F.col("userlimitfactor").try_cast("double")
    return df.withColumn("max_capacity", F.least(F.lit(100.0), F.col("share") * factor))


def queue_drift(requested: DataFrame, observed: DataFrame) -> DataFrame:
    """Settings whose observed value differs from the requested one, one row per setting."""

    def long(df: DataFrame, value: str) -> DataFrame:
        return df.unpivot("queue_name", ["capacity", "user_limit_factor"], "setting", value)

    both = long(requested, "requested").join(long(observed, "observed"), ["queue_name", "setting"])
    return both.filter(F.col("requested") != F.col("observed"))
