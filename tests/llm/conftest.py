import pytest
from pyspark.sql import functions as F

#: Rows that every operator on documents must stand: NULLs, empty and wordless texts, repeats, a long
#: text, and characters of several bytes.
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "word", "a"), (4, "word", "a"), (5, "naïve Straße 日本語 😀", "b"),
    (None, "no id here at all", "b"), (6, "lorem ipsum dolor sit amet " * 4000, "b"), (7, "x" * 50_000, "b"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows, with columns whose names clash with those the operators use inside."""
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, source string")
    return docs.withColumns({
        "lang": F.lit(None).cast("string"), "n_chars": F.length("text"), "id": F.lit("clash"), "_id": F.lit(1), "_host": F.lit(2),
        "_text": F.lit(3), "n_words": F.lit(4), "kept": F.lit(True), "key": F.lit(5), "label": F.lit(6), "part": F.lit(7)})


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
