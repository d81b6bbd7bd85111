"""Merged column profiles."""

import re

from pyspark.sql import functions as F

from jobtrail.functions import profiles, statistics


def table(spark):
    return spark.range(3000).select(
        (F.col("id") % 3).alias("part"), F.when(F.col("id") % 5 > 0, F.col("id") % 700).alias("n"), (F.col("id") / 4).alias("x"),
        F.concat(F.lit("s"), F.col("id") % 11).alias("odd name.s"), F.lit(None).cast("date").alias("d"),
        F.array("id").alias("a"), F.struct("id").alias("s"), F.create_map(F.lit("k"), F.col("id")).alias("m"),
        F.lit("x").cast("binary").alias("b"), (F.col("id") % 2 == 0).alias("flag"))


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_merged_profile_equals_the_whole(spark):
    df = table(spark)
    whole = by_column(profiles.merge_profiles(profiles.profile_parts(df), df.schema))
    parts = profiles.profile_parts(df, ["part"]).drop("part")
    assert parts.count() == 3
    assert by_column(profiles.merge_profiles(parts, df.schema)) == whole
    assert list(whole) == df.columns
    n = whole["n"]
    assert (n["type"], n["count"], n["nulls"], n["min"], n["max"]) == ("bigint", 2400, 600, "1", "699") and n["avg"] == df.agg(F.avg("n")).first()[0]
    assert whole["d"]["nulls"] == 3000 and whole["d"]["ndv"] == 0 and whole["d"]["min"] is None
    for name in "asmb":
        assert (whole[name]["count"], whole[name]["nulls"], whole[name]["ndv"], whole[name]["avg"]) == (3000, 0, None, None)


def test_estimates_are_near_exact_numbers(spark):
    df = table(spark)
    exact = {r["column"]: r["ndv"] for r in profiles.exact_ndv(df).collect()}
    assert exact == {"part": 3, "n": 560, "x": 3000, "odd name.s": 11, "d": 0, "flag": 2}
    got = by_column(profiles.merge_profiles(profiles.profile_parts(df, ["part"]).drop("part"), df.schema))
    assert all(abs(got[c]["ndv"] - n) <= 0.05 * n for c, n in exact.items())


def test_profile_of_an_empty_table(spark):
    df = table(spark).limit(0)
    rows = by_column(profiles.merge_profiles(profiles.profile_parts(df), df.schema))
    assert all(r["count"] == r["nulls"] == 0 for r in rows.values()) and rows["n"]["avg"] is None
    assert len(by_column(profiles.merge_profiles(profiles.profile_parts(df, ["part"]).drop("part"), df.schema))) == len(df.columns)


def test_exact_ndv_of_many_values_takes_many_tasks(spark, rows):
    df = spark.range(5000).coalesce(1).selectExpr(
        "id", "if(id % 2 = 0, 0.0D, -0.0D) as zero", "cast(null as string) as none", "concat('n', id % 7) as name",
        "timestamp_seconds(id div 2) as ts", "date'2024-01-01' as day")
    exact = statistics.compute_stats(df, ndv="exact")
    assert rows(exact, "column", "ndv") == sorted(
        [("id", 5000), ("zero", 1), ("none", 0), ("name", 7), ("ts", 2500), ("day", 1)], key=repr)
    fields = df.select("id", "name").schema.fields
    split = statistics.distinct_values(df, fields, values_a_task=500)
    assert rows(split) == [("id", 5000), ("name", 7)]
    plan = split._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(xxhash64\(id[^\n]*, 20\), REPARTITION_BY_NUM", plan), plan
