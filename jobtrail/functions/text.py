"""Frequent n-grams of tokenised text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_sentences(text: Column) -> Column:
    """Sentences of lower-cased words, by language rules.

    Case helps to find where a sentence ends, so words are lowered after the split.
    """
    return F.transform(F.sentences(text), lambda s: F.transform(s, lambda w: F.lower(w)))


def line_words(text: Column) -> Column:
    """Each line as the list of its letter runs, lower-cased."""
    return F.transform(
        F.split(F.lower(text), "\n"), lambda line: F.regexp_extract_all(line, F.lit(r"(\p{L}+)"), F.lit(1)))


def _grams(df: DataFrame, sentences: Column, n: int) -> DataFrame:
    """One row per n-gram, as a struct ``words`` of ``w0``, ``w1`` ..; a gram never crosses a sentence.

    Sentences become rows first, so a long text is never held as one array of all its grams. A sentence
    zipped with itself, moved by a word each time, gives its grams without an array for each.
    """
    rows = df.select(F.explode(sentences).alias("s")).filter(F.size("s") >= n)
    grams = F.size("s") - (n - 1)
    moved = F.arrays_zip(*[F.slice("s", i + 1, grams).alias(f"w{i}") for i in range(n)])
    return rows.select(F.explode(moved).alias("words"))


def _top(grams: DataFrame, k: int) -> DataFrame:
    """The k most frequent grams. Counting combines map-side, so a gram in every document is cheap."""
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "gram").limit(k)


def ngrams(df: DataFrame, sentences: Column, n: int, k: int) -> DataFrame:
    """Top ``k`` n-grams as (gram, n), exact counts, ties in gram order."""
    gram = F.concat_ws(" ", *[f"words.w{i}" for i in range(n)])
    return _top(_grams(df, sentences, n).select(gram.alias("gram")), k)


def context_ngrams(df: DataFrame, sentences: Column, context: Sequence[str | None], k: int) -> DataFrame:
    """Top ``k`` fillers of the open places (None) of a word pattern.

    ``["of", None]`` counts the words that follow "of".
    """
    grams = _grams(df, sentences, len(context))
    for i, word in enumerate(context):
        if word is not None:
            grams = grams.filter(F.col(f"words.w{i}") == word)
    open_places = [f"words.w{i}" for i, word in enumerate(context) if word is None]
    return _top(grams.select(F.concat_ws(" ", *open_places).alias("gram")), k)
