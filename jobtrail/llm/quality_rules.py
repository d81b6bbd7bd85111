"""Quality rules from text statistics and from lines that many documents of a host share.

Every line is normalised (white space collapsed, lower case, digits as 0) and hashed. Per host the
distinct documents that hold a line are counted; exact copies count as one document. A line above
``max_docs`` is removed from all of its documents but its owner. A document that keeps less than
``min_share`` percent of its words is depleted and rejected, as is one that fails the base rules.

``quality_report`` takes the first document (smallest ``doc_id``) as owner, as its SQL twin does, even
if that document is rejected itself. ``clean`` loses no line that a document within the base rules
holds: the owner is the first document that passes them and is not depleted. If all of these are
depleted, the first one gets all of its lines back and stays whole. ``quality_report`` gives these
verdicts with ``whole=True``.

Defined cases: NULL text has no words and fails the base rules; NULL host is a host of its own; a
line without words is never counted or removed; NULL ``doc_id`` never counts as first; repeated
rows are judged each and equally; an empty table gives an empty result. Further columns of the
input are not touched and may have any name.

The main path is DataFrame expressions only. Per row, windows are hashed to 64 bits and sorted
inside the row; between rows only line hashes move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.texts import BLANK, columns, let
from jobtrail.operators.ordered import join_keys
from jobtrail.session import stage

MAX_DOCS = 20
MIN_SHARE = 30
MIN_WORDS = 50
MAX_REPEATED = 50
#: Parts a host's frequent line is dealt to, so a line of a third of all documents is not one task.
SALTS = 16
KEYS = ["_host", "_text"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: equal hashes meet after a sort, their
    positions are sorted again and the covered words added up without double counting."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def flagged(x: Column, j: Column) -> Column:
                same = F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])
                return F.when(same, x["i"])

            return F.sort_array(F.array_compact(F.transform(s, flagged)))

        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        total = F.aggregate(
            let(pairs, positions), start,
            lambda acc, p: F.struct(
                (acc["total"] + p + 3 - F.greatest(p, acc["end"])).alias("total"), (p + 3).alias("end")),
            lambda acc: acc["total"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(total)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, covered))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _line_hash(line: Column) -> Column:
    blank = F.btrim(F.regexp_replace(F.lower(line), BLANK, " "))
    return F.xxhash64(F.regexp_replace(blank, "[0-9]", "0"))


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One slim row per document: statistics, and hash and length of every line."""
    rows = columns(docs, _id=doc_id, _body=text, _host=host)
    body = F.coalesce("_body", F.lit(""))
    stats = let(words_of(body), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = let(_lines(body), lambda a: F.struct(
        (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        F.transform(a, lambda x: F.struct(
            _line_hash(x).alias("h"), F.size(words_of(x)).cast("long").alias("w"))).alias("lines")))
    return rows.select(
        "_id", "_host", F.xxhash64("_body").alias("_text"), stats.alias("_s"), lines.alias("_l"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    ).select("_id", *KEYS, "_s.*", "_l.*", "n_symbols")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _share_kept(left: Column, min_share: int) -> Column:
    return 100 * left >= min_share * F.col("n_words")


def _first_holder(*worse: str) -> Column:
    """The smallest id's text, after the ``worse`` flags; NULL ids come last."""
    return F.min(F.struct(*worse, F.col("_first").isNull().alias("n"), "_first", "_text"))


def _with_owner(held: DataFrame, owners: DataFrame) -> DataFrame:
    salted = owners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_keys(held.withColumn("_salt", F.pmod("_text", F.lit(SALTS)).cast("int")), salted,
                     ["_host", "h", "_salt"]).drop("_salt")


def removals(rows: DataFrame, max_docs: int = MAX_DOCS, min_share: int = MIN_SHARE, whole: bool = False) -> DataFrame:
    """Per distinct document of a host that loses lines: their hashes and words."""
    texts = rows.filter(F.size("lines") > 0).groupBy(*KEYS).agg(
        F.min("_id").alias("_first"), F.any_value("lines").alias("lines"),
        F.any_value("n_words").alias("n_words"), F.any_value(base_failed()).alias("_failed"))
    held = texts.select(*KEYS, "_first", "n_words", "_failed", F.explode("lines").alias("_x")).groupBy(*KEYS, "_x.h").agg(
        F.min("_first").alias("_first"), F.any_value("n_words").alias("n_words"), F.any_value("_failed").alias("_failed"),
        F.sum("_x.w").alias("_w"))
    held = stage(held if whole else held.drop("n_words", "_failed"), "lines")
    frequent = held.groupBy("_host", "h").agg(
        F.count("*").alias("_docs"), _first_holder(*["_failed"] if whole else []).alias("_owner"),
    ).filter(F.col("_docs") > max_docs)
    shared = _with_owner(held, frequent.select("_host", "h", F.col("_owner._text").alias("_owner")))
    lost = _settled(stage(shared, "shared"), min_share) if whole else shared.filter(F.col("_text") != F.col("_owner"))
    return lost.groupBy(*KEYS).agg(F.sum("_w").alias("_lost"), F.collect_list("h").alias("_gone"))


def _settled(shared: DataFrame, min_share: int) -> DataFrame:
    """Lines that are lost once those of depleted owners have found another one.

    Later owners only get more lines than in the first election, so no further document is depleted.
    """
    left = F.any_value("n_words") - F.sum(F.when(F.col("_text") != F.col("_owner"), F.col("_w")).otherwise(0))
    depleted = shared.filter(~F.col("_failed")).groupBy(*KEYS).agg(
        F.any_value("n_words").alias("n_words"), left.alias("_left"),
    ).filter(~_share_kept(F.col("_left"), min_share)).select(*KEYS, F.lit(True).alias("_depleted"))
    marked = join_keys(shared.drop("_owner"), depleted, KEYS, "left").withColumn(
        "_depleted", F.coalesce("_depleted", F.lit(False)))
    marked = stage(marked, "marked")
    owners = stage(marked.groupBy("_host", "h").agg(_first_holder("_failed", "_depleted").alias("_owner")), "owners")
    restored = owners.filter(~F.col("_owner._failed") & F.col("_owner._depleted")).select(
        "_host", F.col("_owner._text").alias("_text")).distinct()
    lost = _with_owner(marked, owners.select("_host", "h", F.col("_owner._text").alias("_owner"))).filter(
        F.col("_text") != F.col("_owner"))
    return join_keys(lost, restored, KEYS, "left_anti")


def _dealt(rows: DataFrame, facts_of_text: DataFrame, salt: Column) -> DataFrame:
    """Left join on the text, whose copies are dealt to ``SALTS`` parts: one text may be a third of all rows."""
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return join_keys(spread, facts_of_text.select("*", every), [*KEYS, "_salt"], "left").drop("_salt")


def judge(rows: DataFrame, lost: DataFrame, min_share: int = MIN_SHARE) -> DataFrame:
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    return (
        _dealt(rows, lost, F.col("_id"))
        .withColumn("base_failed", base_failed())
        .withColumn("n_words_left", left)
        .withColumn("kept", ~base_failed() & _share_kept(left, min_share))
    )


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                   max_docs: int = MAX_DOCS, min_share: int = MIN_SHARE, whole: bool = False) -> DataFrame:
    """Statistics and verdict of every document; with ``whole``, the verdicts of ``clean``."""
    rows = stage(facts(docs, doc_id, text, host), "facts")
    lost = removals(rows, max_docs, min_share, whole).drop("_gone")
    return judge(rows.drop("lines"), lost, min_share).select(
        F.col("_id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_words_left", "base_failed", "kept")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
          length: str | None = "n_chars", max_docs: int = MAX_DOCS, min_share: int = MIN_SHARE) -> DataFrame:
    """The documents that are kept, in their columns, without the lines above the limit."""
    rows = stage(facts(docs, doc_id, text, host), "facts")
    lost = stage(removals(rows, max_docs, min_share, whole=True), "removals")
    verdict = judge(rows.dropDuplicates(KEYS).drop("lines"), lost, min_share)
    # Only texts that are rejected or lose lines have to be told.
    told = verdict.filter(~F.col("kept") | F.col("_gone").isNotNull()).select(*KEYS, F.col("kept").alias("_kept"), "_gone")
    body = docs[text]
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[host].alias("_host"),
                        F.xxhash64(body).alias("_text"), body.alias("_body"), docs[doc_id].alias("_id"))
    shorter = F.array_join(F.filter(
        F.split("_body", "\n", -1), lambda line: ~F.array_contains("_gone", _line_hash(line))), "\n")
    out = _dealt(keyed, told, F.col("_id")).filter(F.coalesce("_kept", F.lit(True))).withColumn(
        "_body", F.when(F.col("_gone").isNull(), F.col("_body")).otherwise(shorter))
    new = {text: F.col("_body")}
    if length in docs.columns:
        new[length] = F.length("_body").cast(docs.schema[length].dataType)
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
