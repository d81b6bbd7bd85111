"""XML requests, property files and JSON snapshots as typed columns. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail import constants as C

_PROPERTY = "array<struct<_name string, _value string>>"
# Elements are read as arrays: a repeated element must not be silently merged.
_SCHEMAS = {
    "task": "jobinstanceid array<string>, context array<struct<`{tag}` " + _PROPERTY + ">>",
    "operator": "`{tag}` " + _PROPERTY,
    "udf": "udfdescriptor array<struct<udfname string, classname string, jarname string, "
           "descriptor string, author string>>",
    "udf_update": "descriptor array<string>",
    "quota": "quota array<string>",
    "queue": "name array<string>, calcresource array<struct<memtotal string, userlimitfactor string>>",
}
_XML = {"ignoreSurroundingSpaces": "false"}


def named(properties: Column, name: str) -> Column:
    """Value of the last property with that name."""
    hits = F.filter(properties, lambda p: p["_name"] == name)
    return F.try_element_at(hits, F.lit(-1))["_value"]


def has_property(properties: Column, name: str) -> Column:
    return F.coalesce(F.exists(properties, lambda p: p["_name"] == name), F.lit(False))


def parse_requests(df: DataFrame, kind: str, xml: str = "xml", item_tag: str = "property") -> DataFrame:
    """Parse request documents of one kind; adds the typed columns and ``malformed``.

    ``task`` and ``operator`` documents keep their ``properties`` in document order, which
    the validation rules need.
    """
    doc = df.withColumn("_doc", F.from_xml(xml, _schema(kind, item_tag), _XML))
    return doc.withColumns(_columns(kind, item_tag)).drop("_doc")


def read_requests(spark: SparkSession, path: str, kind: str, row_tag: str, item_tag: str = "property") -> DataFrame:
    """Request documents from XML files, each in a ``row_tag`` element; a file may hold many
    under one root."""
    docs = spark.read.format("xml").schema(_schema(kind, item_tag)).options(rowTag=row_tag, **_XML).load(path)
    return docs.select(F.struct("*").alias("_doc")).select(
        *[c.alias(name) for name, c in _columns(kind, item_tag).items()])


def _schema(kind: str, item_tag: str) -> str:
    return _SCHEMAS[kind].format(tag=item_tag) + ", _corrupt_record string"


def _columns(kind: str, item_tag: str) -> dict[str, Column]:
    """Typed columns of the parsed document in ``_doc``."""
    d = F.col("_doc")
    columns = {"malformed": d["_corrupt_record"].isNotNull()}
    if kind == "task":
        context = F.get(d["context"], F.lit(0))
        columns.update({
            "jobinstanceid": F.get(d["jobinstanceid"], F.lit(0)),
            "has_context": context.isNotNull(),
            "properties": F.coalesce(context[item_tag], F.array().cast(_PROPERTY)),
        })
    elif kind == "operator":
        columns["properties"] = F.coalesce(d[item_tag], F.array().cast(_PROPERTY))
    elif kind == "udf":
        descriptors = d["udfdescriptor"]
        for name in ("udfname", "classname", "jarname", "descriptor", "author"):
            present = F.filter(descriptors[name], lambda v: v.isNotNull())
            columns[name] = F.get(present, F.lit(0))
    elif kind in ("udf_update", "quota"):
        name = "descriptor" if kind == "udf_update" else "quota"
        columns[name] = F.get(d[name], F.lit(0))
    elif kind == "queue":
        resources = d["calcresource"]
        columns["name"] = F.try_element_at(d["name"], F.lit(-1))
        for name in ("memtotal", "userlimitfactor"):
            present = F.filter(resources[name], lambda v: v.isNotNull())
            columns[name] = F.try_element_at(present, F.lit(-1))
    return columns


def read_properties(df: DataFrame, xml: str = "xml") -> DataFrame:
    """``<property><name/><value/></property>`` lists as (pos, name, value) rows, other columns kept.

    ``pos`` is the place in the list: a property may repeat.
    """
    schema = "property array<struct<name string, value string>>"
    keep = [c for c in df.columns if c != xml]
    return df.select(*keep, F.posexplode(F.from_xml(xml, schema, _XML)["property"]).alias("pos", "_p")).select(
        *keep, "pos", "_p.name", "_p.value")


_QUEUE = ("queueName string, capacity string, maxCapacity string, userLimitFactor string, "
          "maxApplications string, numActiveApplications string, numPendingApplications string, "
          "resourcesUsed struct<memory double, vCores double>")


def read_scheduler(df: DataFrame, json: str = "json") -> DataFrame:
    """One row per queue of each scheduler snapshot, in document order (``pos``)."""
    schema = f"scheduler struct<schedulerInfo struct<queues struct<queue array<struct<{_QUEUE}>>>>>"
    keep = [c for c in df.columns if c != json]
    queues = F.from_json(json, schema)["scheduler"]["schedulerInfo"]["queues"]["queue"]
    return df.select(*keep, F.posexplode(queues).alias("pos", "q")).select(
        *keep, "pos",
        F.col("q.queueName").alias("queue_name"),
        F.col("q.capacity").try_cast("double").alias("capacity"),
        F.col("q.maxCapacity").try_cast("double").alias("max_capacity"),
        F.col("q.userLimitFactor").try_cast("double").alias("user_limit_factor"),
        F.col("q.maxApplications").try_cast("bigint").alias("max_applications"),
        F.col("q.numActiveApplications").try_cast("bigint").alias("active_applications"),
        F.col("q.numPendingApplications").try_cast("bigint").alias("pending_applications"),
        F.col("q.resourcesUsed.memory").alias("mem_used"),
        F.col("q.resourcesUsed.vCores").alias("vcores_used"),
    )


def read_roles(df: DataFrame, json: str = "json") -> DataFrame:
    """One row per role: name, type, HA status and configuration group."""
    schema = ("items array<struct<name string, type string, haStatus string, "
              "roleConfigGroupRef struct<roleConfigGroupName string>>>")
    keep = [c for c in df.columns if c != json]
    return df.select(*keep, F.posexplode(F.from_json(json, schema)["items"]).alias("pos", "r")).select(
        *keep, "pos", "r.name", "r.type", F.col("r.haStatus").alias("ha_status"),
        F.col("r.roleConfigGroupRef.roleConfigGroupName").alias("group_name"),
    )


def read_role_groups(df: DataFrame, json: str = "json") -> DataFrame:
    """One row per configuration group with its first memory and vcores setting (0 if absent)."""
    schema = ("items array<struct<name string, roleType string, "
              "config struct<items array<struct<name string, value string>>>>>")
    keep = [c for c in df.columns if c != json]

    def setting(name: str) -> Column:
        hits = F.filter(F.col("g.config.items"), lambda s: s["name"] == name)
        return F.coalesce(F.get(hits, F.lit(0))["value"].try_cast("int"), F.lit(0))

    return df.select(*keep, F.explode(F.from_json(json, schema)["items"]).alias("g")).select(
        *keep, F.col("g.name").alias("group_name"), F.col("g.roleType").alias("role_type"),
        setting(C.MEMORY_SETTING).alias("memory_mb"), setting(C.VCORES_SETTING).alias("vcores"),
    )
