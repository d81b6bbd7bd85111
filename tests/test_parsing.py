from pyspark.sql import functions as F

from jobtrail.functions import parsing as P
from jobtrail.functions.scalars import field, in_file, index, index_map, parse_url_tuple


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")


def test_app_ids_at_the_digit_limit(spark, rows):
    df = lines(
        spark,
        "INFO Submitted application application_1700000000001_9999",
        "INFO Submitted application application_1700000000001_10000",
        "INFO Submitted application application_1700000000001_999",
        "INFO Submitted application application_1700000000001_1234 ",
        "INFO Running application application_1700000000001_1234",
        "Submitted application application_170000000000_1234",
        None,
    )
    assert rows(P.extract_app_ids(df)) == [
        (0, "application_1700000000001_9999"), (1, "application_1700000000001_10000")]
    assert rows(P.extract_app_ids(df, strict=True)) == [(0, "application_1700000000001_9999")]


def test_all_digits_of_the_number_count(spark, rows):
    df = spark.createDataFrame([("application_1700000000001_0042",), ("application_1700000000001_12345",), ("x",)], "a string")
    out = df.select("a", P.parse_app_id(F.col("a")).alias("p")).select("a", "p.*")
    assert rows(out) == [
        ("application_1700000000001_0042", 1700000000001, 42),
        ("application_1700000000001_12345", 1700000000001, 12345), ("x", None, None)]


def test_stamps(spark, rows):
    df = spark.createDataFrame([("2015-07-01_12-30-45-123",), ("2015-07-01_12-30-45",), ("bad",)], "s string")
    out = P.stamp_parts(df, "s").select("s", F.date_format("stamp_ts", "HH:mm:ss.SSS").alias("t"), "stamp_date", "stamp_time")
    assert rows(out) == [
        ("2015-07-01_12-30-45", "12:30:45.000", "2015-07-01", "12-30-45"),
        ("2015-07-01_12-30-45-123", "12:30:45.123", "2015-07-01", "12-30-45-123"),
        ("bad", None, "bad", "")]


def test_engine(spark, rows):
    df = spark.createDataFrame([("HV.a.b",), ("SKop",), (None,), ("GM.x",)], "o string")
    out = df.select("o", P.engine_of(F.col("o")).alias("e"), P.engine_class(F.col("o")).alias("c"))
    assert rows(out) == sorted(
        [("HV.a.b", "HV", "hive"), ("SKop", None, "yarn"), (None, None, "yarn"), ("GM.x", "GM", "yarn")], key=repr)


def test_quota(spark, rows):
    texts = ["10GB", "50GB", "51GB", "xGB", "", None, "7", "GB", "-3GB", " 5GB", "99999999999999GB", "12MB"]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    got = {r["q"]: r["b"] for r in df.select("q", P.parse_quota(F.col("q")).alias("b")).collect()}
    gb = 1024 ** 3
    assert got == {"10GB": 10 * gb, "50GB": 50 * gb, "51GB": 51 * gb, "xGB": None, "": None, None: None, "7": None,
                   "GB": None, "-3GB": -3 * gb, " 5GB": None, "99999999999999GB": None, "12MB": 12 * gb}


def test_field_and_index(spark, rows):
    df = spark.createDataFrame([("b", [1, 2], {"x": 9}), (None, [], {})], "s string, a array<int>, m map<string,int>")
    out = df.select(field(F.col("s"), "a", "b").alias("f"), index(F.col("a"), 1).alias("i"), index_map(F.col("m"), "x").alias("m"))
    assert rows(out) == sorted([(2, 2, 9), (0, None, None)], key=repr)


def test_url_parts_of_bad_urls_are_null(spark, rows):
    df = spark.createDataFrame([("http://h.org/p?x=1#f",), ("http://bad host/",)], "u string")
    out = df.select(*parse_url_tuple(F.col("u"), ["HOST", "PATH", "QUERY:x", "REF"]))
    assert out.columns == ["host", "path", "query_x", "ref"]
    assert rows(out) == sorted([("h.org", "/p", "1", "f"), (None, None, None, None)], key=repr)


def test_in_file(spark, rows, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("a\nb\nb\n")
    df = spark.createDataFrame([("a",), ("c",), (None,), ("b",), ("b",)], "w string")
    assert rows(in_file(df, "w", str(path), "hit")) == sorted(
        [("a", True), ("c", False), (None, False), ("b", True), ("b", True)], key=repr)
