import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobtrail.functions import registered, statistics, text
from jobtrail.functions.matching import matchpath
from jobtrail.functions.scalars import xpath_texts
from jobtrail.plans import QUERIES
from jobtrail.plans.registry import Tables

DOCS = ["The cat sat.\nThe cat ran, the dog sat", "the cat", "", "Été à la mer; été à Paris", None, "one"]


def documents(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "i int, text string")


def brute_grams(n):
    counts = Counter()
    for doc in DOCS:
        for line in (doc or "").lower().split("\n"):
            words = re.findall(r"[^\W\d_]+", line)
            counts.update(" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
    return counts


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams(spark, n):
    got = [(r["gram"], r["n"]) for r in text.ngrams(documents(spark), text.line_words(F.col("text")), n, 6).collect()]
    assert got == sorted(brute_grams(n).items(), key=lambda g: (-g[1], g[0]))[:6]


def test_ngrams_of_sentences_do_not_cross(spark):
    got = {r["gram"] for r in text.ngrams(documents(spark), text.word_sentences(F.col("text")), 2, 100).collect()}
    assert "the cat" in got and "sat the" not in got


def test_grams_are_built_without_an_array_each(spark):
    docs = documents(spark)
    for grams in (text.ngrams(docs, text.word_sentences(F.col("text")), 3, 5),
                  text.context_ngrams(docs, text.line_words(F.col("text")), ["the", None], 5)):
        plan = grams._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "arrays_zip(" in plan


def test_context_ngrams(spark):
    got = text.context_ngrams(documents(spark), text.line_words(F.col("text")), ["the", None], 5).collect()
    assert [(r["gram"], r["n"]) for r in got] == [("cat", 3), ("dog", 1)]
    got = text.context_ngrams(documents(spark), text.line_words(F.col("text")), ["the", None, None], 5).collect()
    assert [(r["gram"], r["n"]) for r in got] == [("cat ran", 1), ("cat sat", 1), ("dog sat", 1)]


def brute_paths(events, pattern):
    regex = re.compile(pattern)
    users = {}
    for user, ts, sym in sorted(events):
        users.setdefault(user, []).append(sym)
    return sorted(
        (user, i + 1, len(m.group()))
        for user, syms in users.items() for i in range(len(syms))
        if (m := regex.match("".join(syms), i)) and m.group())


@pytest.mark.parametrize("limit", [100_000, 60])
@pytest.mark.parametrize("pattern,regex", [
    ("a.b*.c", "ab*c"), ("a.a+", "aa+"), ("a+.b", "a+b"), ("a.b.a", "aba"), ("b*.c", "b*c"), ("a.b*.a", "ab*a"),
    ("c+", "c+"), ("a.a.b+", "aab+"), ("b*", "b*"), ("a*.b*.c", "a*b*c"), ("a.c*", "ac*"),
])
def test_matchpath(spark, rows, limit, pattern, regex):
    import random
    rnd = random.Random(7)
    events = [(0 if i % 3 == 0 else rnd.randrange(1, 9), i, rnd.choice("aabbc")) for i in range(400)]
    df = spark.createDataFrame(events, "user int, ts int, sym string").repartition(5)
    got = matchpath(df, ["user"], ["ts"], F.col("sym"), pattern, group_limit=limit)
    assert rows(got, "user", "sequence", "size") == sorted(brute_paths(events, regex), key=repr)


def test_matchpath_rejects_an_impossible_chain(spark):
    df = spark.createDataFrame([(1, 1, "a")], "user int, ts int, sym string")
    with pytest.raises(ValueError):
        matchpath(df, ["user"], ["ts"], F.col("sym"), "a+.a")


def test_bitmaps(spark, rows):
    data = [("x", p) for p in (0, 1, 1, 40_000, 90_000)] + [("y", p) for p in (1, 40_000, 70_000)] + [("z", 5)]
    maps = statistics.bitmap_build(spark.createDataFrame(data, "k string, p bigint"), "p", ["k"])
    assert rows(statistics.bitmap_cardinality(maps, ["k"])) == [("x", 4), ("y", 3), ("z", 1)]
    assert rows(statistics.bitmap_cardinality(statistics.bitmap_or(maps))) == [(6,)]
    both = statistics.bitmap_and(maps.filter("k <> 'z'"), "k", 2)
    assert rows(statistics.bitmap_cardinality(both)) == [(2,)]
    none = statistics.bitmap_and(maps, "k", 3)
    assert rows(none.select(statistics.bitmap_is_empty(F.col("bitmap")))) == [(True,)]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "b", 2.5, [1]), (None, "a", 0.5, None), (3, None, None, None)],
                               "n int, s string, d double, skipped array<int>")
    got = {r["column"]: tuple(r)[1:] for r in statistics.compute_stats(df, ndv="exact").collect()}
    assert got == {"n": (2, 1, "1", "3", 2.0, 2), "s": (2, 1, "a", "b", None, 2), "d": (2, 1, "0.5", "2.5", 1.5, 2)}


def test_registered_aggregate_merges_batches(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [("hot" if i % 3 else None, i) for i in range(300)]
        df = spark.createDataFrame(data, "k string, v int").repartition(6)
        out = registered.apply_aggregate(
            df, ["k"], lambda pdf: {"low": int(pdf["v"].min()), "n": len(pdf)}, {"low": F.min, "n": F.sum},
            F.col("low") + F.col("n"), ["v"], "low bigint, n bigint", "r", "bigint")
        assert rows(out) == sorted([("hot", 1 + 200), (None, 0 + 100)], key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_registered_table_function(spark, rows):
    class Letters:
        def eval(self, word: str):
            for i, c in enumerate(word or ""):
                yield c, i

    registered.register_table_function(spark, "test_letters", Letters, "c string, i int")
    df = spark.createDataFrame([("ab",), (None,)], "w string")
    assert rows(spark.sql("select w, c, i from {d}, lateral test_letters(w)", d=df)) == [("ab", "a", 0), ("ab", "b", 1)]


def test_xpath_texts_parse_a_document_once(spark):
    docs = spark.createDataFrame(
        [(1, "<a><b>x &lt; y|z</b><b/><n>2.50</n></a>"), (2, "<a><b></b></a>"), (3, None)], "i int, d string")
    got = docs.select("i", xpath_texts(F.col("d"), "a/b", "a/b[2]", "a/n > 2", "number(a/n)", "a/n mod 2").alias("x"))
    assert [tuple(r) for r in got.orderBy("i").collect()] == [
        (1, ["x < y|z", "", "true", "2.5", "0.5"]), (2, ["", "", "false", "NaN", "NaN"]), (3, None)]


def test_f8_xpath_parses_a_document_once(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey < 100")
    orders = orders.unionByName(orders.limit(2).withColumns({"o_orderkey": F.col("o_orderkey") + 1000, "o_orderpriority": F.lit("")}))
    orders = orders.unionByName(orders.limit(2).withColumns({
        "o_orderkey": F.col("o_orderkey") + 2000, "o_orderstatus": F.lit(None).cast("string")}))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["f8_xpath"](spark, str(tmp_path))
    assert len(re.findall(r"XPath\w+Evaluator", got._jdf.queryExecution().optimizedPlan().toJSON())) == 1
    docs = Tables(spark, str(tmp_path)).sql("""
      select *, '<o><p>' || o_orderpriority || '</p><p>' || o_orderstatus || '</p><v>' || cast(o_totalprice as decimal(18, 2)) ||
        '</v><c>' || o_custkey || '</c><k>' || o_orderkey || '</k></o>' as d from {orders}""")
    want = docs.selectExpr(
        "o_orderkey", "array_join(xpath(d, 'o/p/text()'), '|')", "xpath_boolean(d, 'o/v > 200000')",
        "round(xpath_double(d, 'o/v'), 2)", "round(xpath_number(d, 'o/v'), 2)", "xpath_float(d, 'o/c')", "xpath_int(d, 'o/c')",
        "xpath_long(d, 'o/k')", "xpath_short(d, 'o/c mod 100')", "xpath_string(d, 'o/p[2]')")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.dtypes == [(n, t) for n, (_, t) in zip(got.columns, want.dtypes)]
