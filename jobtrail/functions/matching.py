"""Row patterns over ordered groups.

A pattern is a chain of symbols such as ``view.click+.purchase``: a bare symbol matches one row,
``+`` one or more, ``*`` any number, all greedy. Every row may start a match, and each start
yields one result with the number of rows the match covers.

Rows are first folded into runs of equal symbols. A chain then spans a bounded number of runs
whatever the length of the group, so no group is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.operators.ordered import GROUP_LIMIT, join_keys, largest_group, sequence_rows
from jobtrail.session import stage


def _steps(pattern: str) -> list[tuple[str, int, bool]]:
    """(symbol, least rows, open-ended) with neighbouring steps of one symbol merged."""
    steps: list[tuple[str, int, bool]] = []
    for part in pattern.split("."):
        symbol, many = part.rstrip("+*"), part[-1:] in ("+", "*")
        least = 0 if part.endswith("*") else 1
        if steps and steps[-1][0] == symbol:
            if steps[-1][2] and least > 0:
                raise ValueError(f"{pattern}: the greedy step before {part} leaves it no row")
            steps[-1] = (symbol, steps[-1][1] + least, steps[-1][2] or many)
        else:
            steps.append((symbol, least, many))
    return steps


def matchpath(df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: Column, pattern: str,
              keep: Sequence[str] = (), group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Matches of ``pattern``: keys, ``keep`` columns of the first row, its ``sequence`` and ``size``."""
    keys, steps = list(keys), _steps(pattern)
    rows = df.select(*keys, *order, *[c for c in keep if c not in order and c not in keys], symbol.alias("_sym"))
    # A symbol or the runs of a key never outnumber its rows, so one measurement serves all three.
    size = {"group_limit": group_limit, "largest": largest_group(rows, keys), "number_type": "bigint"}
    rows = sequence_rows(rows, keys, order, **size)
    rows = sequence_rows(rows, [*keys, "_sym"], order, number="_nth", **size)
    # Within one symbol, sequence minus rank is constant along a run.
    rows = stage(rows.withColumn("_run", F.col("sequence") - F.col("_nth")).drop("_nth"), "rows")

    runs = rows.groupBy(*keys, "_sym", "_run").agg(
        F.min("sequence").alias("_from"), F.count("*").alias("_len"))
    ahead = {f"_r{i}": ("_this", i) for i in range(1, len(steps))}
    runs = runs.withColumn("_this", F.struct("_sym", "_len"))
    runs = sequence_rows(runs, keys, ["_from"], number="_no", following=ahead, **size)
    runs = runs.select(*keys, "_sym", "_run", "_from", F.array("_this", *ahead).alias("_runs"))

    # A match starts at a row of the first symbol that must occur, or of an optional one before it.
    first = next((i for i, step in enumerate(steps) if step[1] > 0), len(steps) - 1)
    heads = rows.filter(F.col("_sym").isin(*[name for name, _, _ in steps[: first + 1]]))
    starts = join_keys(heads, runs.withColumnRenamed("_from", "_start"), [*keys, "_sym", "_run"])

    # Walk the chain: ``at`` is the run in use, ``used`` the rows of it already taken.
    chain = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(least).cast("bigint").alias("least"), F.lit(many).alias("many"))
        for name, least, many in steps
    ])
    begin = F.struct(
        F.lit(0).alias("at"), (F.col("sequence") - F.col("_start")).alias("used"),
        F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("ok"),
    )

    def advance(state: Column, step: Column) -> Column:
        run = F.get("_runs", state["at"])
        left = F.when(run["_sym"] == step["name"], run["_len"] - state["used"]).otherwise(F.lit(0).cast("bigint"))
        take = F.when(step["many"], left).otherwise(F.least(left, step["least"]))
        done = (left > 0) & (take == left)
        return F.struct(
            F.when(done, state["at"] + 1).otherwise(state["at"]).alias("at"),
            F.when(done, F.lit(0).cast("bigint")).otherwise(state["used"] + take).alias("used"),
            (state["size"] + take).alias("size"),
            (state["ok"] & (left >= step["least"])).alias("ok"),
        )

    walked = starts.withColumn("_end", F.aggregate(chain, begin, advance))
    return walked.filter(F.col("_end.ok") & (F.col("_end.size") > 0)).select(
        *keys, *keep, "sequence", F.col("_end.size").alias("size"))
