"""Every registered query against its SQL twin, and what its plan must not contain."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import KINDS, ordered
from jobtrail.fixtures import BASE, table

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    if name not in ORACLE:
        assert got
        return
    rel = con.execute(ORACLE[name])
    kinds = {d[0]: str(d[1]) for d in rel.description}
    assert sorted(kinds) == sorted(df.columns)
    assert [(c, KINDS[t]) for c, t in df.dtypes] == [(c, kinds[c]) for c in df.columns]
    assert ordered(got, df.columns) == ordered(rel.fetchall(), list(kinds))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["otid", "opid", "n_apps", "last_appid", "status"] and df.count() > 0


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_function_registries_grow_with_their_table(spark):
    def sizes(sf):
        names = ("udf_v", "funcs_v")
        return [table(spark, f"/root/testdata/sf{sf}", n).count() for n in names]

    for small, medium, large in zip(sizes("0.001"), sizes("0.01"), sizes("0.1")):
        assert small < medium / 2 < medium < large / 2
