"""A registry after a batch of registrations, updates and deletes in order.

Each event is a transition of its name: a registration turns absent into present and fails on present, an
update and a deletion fail on absent, a deletion turns present into absent. What a name is before an event
depends on the last registration or deletion before it alone (present after the one, absent after the other,
accepted or not), and on the registry if there was none. So the events need no fold in one task: they
are numbered per name, and the nearest such event before each one is looked up in two steps, inside
blocks of bounded size and over one small row a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtrail.operators.keys import mark_existing
from jobtrail.operators.ordered import GROUP_LIMIT, join_keys, sequence_rows
from jobtrail.session import stage

REGISTER, UPDATE, DELETE = "register", "update", "delete"
#: Rows of one key that one window sorts.
BLOCK = 100_000


def last_before(df: DataFrame, keys: Sequence[str], number: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Add the nearest ``value`` that is not NULL among the rows of the key with smaller numbers.

    ``number`` counts the rows of each key from 1. A key of any size is cut into blocks, so no task sorts
    more than a block of it; the last values of the blocks are one row for each block.
    """
    keys = list(keys)
    cut = df.withColumn("_block", F.expr(f"({number} - 1) div {block}"))
    earlier = W.unboundedPreceding, -1
    inside = W.partitionBy(*keys, "_block").orderBy(number).rowsBetween(*earlier)
    over = W.partitionBy(*keys).orderBy("_block").rowsBetween(*earlier)
    ends = cut.groupBy(*keys, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(number))).alias("_end"))
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(over)).drop("_end")
    joined = join_keys(cut.withColumn("_here", F.last(value, ignorenulls=True).over(inside)), ends, [*keys, "_block"])
    return joined.withColumn(out, F.coalesce("_here", "_carried")).drop("_block", "_here", "_carried")


def judge_events(events: DataFrame, registry: DataFrame, key: str, order: str, messages: dict[str, str],
                 group_limit: int = GROUP_LIMIT, block: int = BLOCK) -> DataFrame:
    """Events with ``reason``: empty if the event takes effect, else why not.

    ``events`` has the key (never NULL), ``kind``, ``order`` (unique for a key) and ``error``; an event with an
    error is refused for it and changes nothing. ``messages`` holds one format for each kind. The result is
    staged and keeps the place of each event as ``_n``.
    """
    numbered = sequence_rows(stage(events, "events"), [key], [order], number="_n", number_type="bigint", group_limit=group_limit)
    leaves = F.when(F.col("error") != "", F.lit(None)).when(F.col("kind") == REGISTER, True).when(F.col("kind") == DELETE, False)
    before = last_before(numbered.withColumn("_leaves", leaves), [key], "_n", "_leaves", "_was", block)
    present = F.coalesce("_was", "_known")
    works = F.when(F.col("kind") == REGISTER, ~present).otherwise(present)
    refusal = F.coalesce(*[F.when(F.col("kind") == k, F.format_string(m, F.col(key))) for k, m in messages.items()])
    judged = mark_existing(before, registry, key, "_known").withColumn(
        "reason", F.when(F.col("error") != "", F.col("error")).when(works, "").otherwise(refusal))
    return stage(judged.drop("_leaves", "_was", "_known"), "judged-events")


def registry_after(judged: DataFrame, registry: DataFrame, key: str, updated: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The registry after the accepted events: ``updated`` columns follow registrations and updates, ``kept``
    ones registrations alone. Every event of a name is combined map-side, so a busy name is one row a task."""
    done = judged.filter("reason = ''")
    registered, deleted = F.col("kind") == REGISTER, F.col("kind") == DELETE
    # An update is accepted while its name is present, so after the last registration the last one holds.
    changes = done.groupBy(key).agg(
        F.max_by(~deleted, F.when(registered | deleted, F.col("_n"))).alias("_present"),
        F.max_by(F.struct(*updated), F.when(~deleted, F.col("_n"))).alias("_updated"),
        F.max_by(F.struct(*kept), F.when(registered, F.col("_n"))).alias("_kept"))
    old = registry.select(key, F.lit(True).alias("_old"), *updated, *kept)
    both = old.join(changes, key, "full").filter(F.coalesce("_present", "_old"))

    def pick(name: str, part: str) -> F.Column:
        return F.when(F.col(part).isNotNull(), F.col(f"{part}.{name}")).otherwise(F.col(name)).alias(name)

    return both.select(key, *[pick(c, "_updated") for c in updated], *[pick(c, "_kept") for c in kept])
