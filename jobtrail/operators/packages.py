"""Package contents: completeness, the submit jar, and stale local copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C
from jobtrail.functions.parsing import engine_of


def package_check(entries: DataFrame, operators: DataFrame | None = None) -> DataFrame:
    """Does the package of each operator hold every required entry, and which are missing.

    Without ``operators``, of each operator that has a package.

    One flag per required entry: the aggregate state stays four booleans per operator however
    many entries a package has.
    """
    opid = F.col("opid")
    required = {
        "run.sh": F.concat(opid, F.lit("/run.sh")),
        "<opid>.jar": F.concat(opid, F.lit("/"), opid, F.lit(".jar")),
        "description.xml": F.concat(opid, F.lit("/description.xml")),
        "ui.xml": F.concat(opid, F.lit("/ui.xml")),
    }
    have = entries.groupBy("opid").agg(*[
        F.bool_or(F.col("entry") == path).alias(f"_{i}") for i, path in enumerate(required.values())
    ])
    missing = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.col(f"_{i}"), F.lit(False)), name) for i, name in enumerate(required)
    ]))
    asked = have if operators is None else operators.select("opid").distinct().join(have, "opid", "left")
    return (
        asked.select("opid", missing.alias("missing"))
        .withColumn("complete", F.size("missing") == 0)
    )


def script_uses(lines: DataFrame, pattern: str, out: str = "uses") -> DataFrame:
    """Per operator: does any line that is not a comment match ``pattern``."""
    live = ~F.trim("line").startswith("#")
    return lines.groupBy("opid").agg(F.bool_or(live & F.col("line").rlike(pattern)).alias(out))


def submit_jar_check(entries: DataFrame, script_lines: DataFrame, operators: DataFrame | None = None) -> DataFrame:
    """Single-machine operators must ship the submit jar and call it from their script.

    Without ``operators``, of each operator that has a package.
    """
    single = engine_of(F.col("opid")) == C.SINGLE_MACHINE_ENGINE
    ships = entries.filter(single).groupBy("opid").agg(
        F.bool_or(F.col("entry").rlike(C.SUBMIT_JAR + "$")).alias("ships_jar"))
    uses = script_uses(script_lines.filter(single), C.SUBMIT_JAR, "uses_jar")
    no = F.lit(False)
    asked = ships if operators is None else (
        operators.filter(single).select("opid").distinct().join(ships, "opid", "left"))
    return (
        asked.join(uses, "opid", "left")
        .select("opid", F.coalesce("ships_jar", no).alias("ships_jar"),
                F.coalesce("uses_jar", no).alias("uses_jar"))
        .withColumn("submits", F.col("ships_jar") & F.col("uses_jar"))
    )


def stale_packages(local: DataFrame, published: DataFrame) -> DataFrame:
    """Published packages whose local copy is missing or carries another checksum."""
    mine = local.select("opid", F.col("checksum").alias("local_checksum"))
    joined = published.select("opid", "checksum").join(mine, "opid", "left")
    return joined.withColumn("stale", ~F.col("checksum").eqNullSafe(F.col("local_checksum"))
                             | F.col("local_checksum").isNull())
