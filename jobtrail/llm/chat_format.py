"""Transcript parsing: roles of lines by a hidden Markov model, then canonical turns.

A line is described by its speaker marker (``User:``, ``### Assistant``, ``Q:`` .. or none), its
length, whether it asks, and whether a blank line precedes it. Hidden states are a role and
whether the line opens a turn or goes on with it. Viterbi finds the most likely states of a
conversation; rendering drops markers and writes a header line where a turn opens.

The lines of a conversation are numbered in their order, and a conversation of any length is cut into blocks of
``BLOCK`` lines, however many of them share a position. A block is summed up by the best score
between any two of its border states (a max-plus matrix); matrices of ``FAN`` neighbours multiply into one until one
group is left, and the best border states are handed back down. So no task sees more than a
block or ``FAN`` small matrices, and the path is the one Viterbi finds on the whole.

Defined cases: NULL lines are empty lines; lines come in the order of their position (one column or several), equal positions in the order of
their texts, NULL positions first; NULL conversation ids are one conversation; repeated rows are all kept; an empty table gives
an empty result. Further columns of the input are not touched and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtrail.llm.texts import columns
from jobtrail.operators.ordered import join_keys
from jobtrail.session import stage

ROLES = ("system", "user", "assistant")
#: Words that name a role in a speaker marker.
SPEAKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "q", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "a", "agent", "gpt"),
}
MARKER = re.compile(
    r"^\s*(?:#{1,4}\s*|<\|?|\[|\*\*)?(" + "|".join(n for names in SPEAKERS.values() for n in names)
    + r")(?:\|?>|\]|\*\*)?\s*(?::\**|$)\s*", re.I)
_ROLE_OF = {name: at + 1 for at, names in enumerate(SPEAKERS.values()) for name in names}
BLOCK = 256
FAN = 256
#: Hidden states: opening and continuing lines of each role, and the state before the first line.
STATES = 2 * len(ROLES)
BEFORE = STATES
OBSERVED = (1 + len(ROLES)) * 3 * 2 * 2


def marker_of(line: str) -> tuple[int, int]:
    """(role number from 1, or 0 without a marker; where the rest of the line begins)."""
    found = MARKER.match(line)
    return (_ROLE_OF[found[1].lower()], found.end()) if found else (0, 0)


def observe(line: str, after_blank: bool) -> int:
    marker, at = marker_of(line)
    rest = line[at:].strip()
    size = 0 if not rest else 1 if len(rest) < 240 else 2
    return ((marker * 3 + size) * 2 + rest.endswith("?")) * 2 + after_blank


class Model:
    """Log scores of steps between states and of observations in states."""

    def __init__(self, steps: np.ndarray, seen: np.ndarray):
        steps, seen = steps + 0.5, seen + 0.1
        steps[:, BEFORE] = 0
        for state in range(0, STATES, 2):  # a turn only goes on in its own role
            other = [s for s in range(STATES + 1) if s not in (state, state + 1)]
            steps[other, state + 1] = 0
        with np.errstate(divide="ignore"):
            self.steps = np.log(steps / steps.sum(1, keepdims=True))
            self.seen = np.log(seen / seen.sum(1, keepdims=True))

    def matrix(self, observed: list[int]) -> np.ndarray:
        """Best score from every border state before the lines to every state of the last one."""
        best = np.full((STATES + 1, STATES + 1), -np.inf)
        np.fill_diagonal(best, 0)
        for o in observed:
            best = product(best, self.steps + np.append(self.seen[:, o], -np.inf)[None, :])
        return best

    def path(self, observed: list[int], begin: int, end: int) -> list[int]:
        """States of the lines on the best path between two border states."""
        score = np.full(STATES + 1, -np.inf)
        score[begin] = 0
        back = []
        for o in observed:
            reach = score[:, None] + self.steps + np.append(self.seen[:, o], -np.inf)[None, :]
            back.append(reach.argmax(0))
            score = reach.max(0)
        states = [end]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        return states[-2::-1]


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left[:, :, None] + right[None, :, :]).max(1)


def borders(matrices: list[np.ndarray], begin: int, end: int | None) -> list[tuple[int, int]]:
    """Border states of each matrix on the best path through all of them."""
    score = np.full(STATES + 1, -np.inf)
    score[begin] = 0
    back = []
    for m in matrices:
        reach = score[:, None] + m
        back.append(reach.argmax(0))
        score = reach.max(0)
    state = int(score.argmax()) if end is None else end
    out = []
    for step in reversed(back):
        before = int(step[state])
        out.append((before, state))
        state = before
    return out[::-1]


def default_model() -> Model:
    """Markers tell the role, turns alternate, a blank line often ends one."""
    steps = np.zeros((STATES + 1, STATES + 1))
    seen = np.zeros((STATES, OBSERVED))
    follows = {0: (0, 8, 1), 1: (0, 1, 8), 2: (0, 8, 1), 3: (4, 8, 1)}
    for state in range(STATES + 1):
        role = state // 2
        for other, weight in enumerate(follows[role]):
            steps[state, 2 * other] = weight
        if state < BEFORE:
            steps[state, role * 2 + 1] = 12
    for state in range(STATES):
        for o in range(OBSERVED):
            marker, blank = o // 12, o % 2
            if state % 2:
                fit = 20 if marker == 0 else 0.05
                seen[state, o] = fit * (0.5 if blank else 1)
            else:
                seen[state, o] = {0: 3, state // 2 + 1: 30}.get(marker, 0.1) * (2 if blank else 1)
    return Model(steps, seen)


def _grouped(rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``applyInArrow`` over groups of bounded size, as lists of columns."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return fn(table)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def _numbered(rows: DataFrame, positions: list[str]) -> DataFrame:
    """Rows with their number in their conversation, from 0.

    Rows are dealt by range over conversation and order, and rows that are equal in both by an id, so
    no conversation, position or repeated line is one task's. The ids are staged: range bounds are sampled.
    """
    rows = stage(rows.withColumn("_tie", F.monotonically_increasing_id()), "lines")
    order = ["conv", *positions, "line", "_tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stage(ranged, "ranged").withColumn("_piece", F.shiftright("_at", 33))
    # One row for each conversation of a partition; a conversation has one in each partition at most.
    before = W.partitionBy("conv").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("conv", "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")).withColumn(
        "_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    number = F.col("_before") + F.col("_at") - F.col("_first")
    return join_keys(ranged, starts, ["conv", "_piece"]).select("conv", *positions, "line", number.alias("number"))


def _lines_of(table: pa.Table, block: int) -> tuple[pa.Table, list[str], list[int]]:
    """The lines of a block and what is observed in them; the last line of the block before tells about the first."""
    table = table.sort_by("number")
    lines = [x or "" for x in table.column("line").to_pylist()]
    blank = [False, *(not x.strip() for x in lines[:-1])]
    observed = [observe(x, b) for x, b in zip(lines, blank)]
    skip = int(table.column("number")[0].as_py() // block < table.column("idx")[0].as_py())
    return table.slice(skip), lines[skip:], observed[skip:]


def parse(lines: DataFrame, conv_id: str = "conv_id", position: str | Sequence[str] = "pos", line: str = "line",
          model: Model | None = None, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Per line: conversation, position, number in the conversation, recovered role, whether it opens a turn, rendered text."""
    model = model or default_model()
    named = [position] if isinstance(position, str) else list(position)
    at = [f"pos{k}" for k in range(len(named))]
    rows = columns(lines, conv=conv_id, line=line, **dict(zip(at, named))).select(
        "conv", *[F.col(p).cast("long").alias(p) for p in at], "line")
    kind = rows.schema["conv"].dataType.simpleString()
    # The last line of a block also goes to the next one, where the first line must know whether it is blank.
    own = F.floor(F.col("number") / block).cast("long")
    both = F.when(F.pmod("number", F.lit(block)) == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    rows = stage(_numbered(rows, at).withColumn("idx", F.explode(both)), "numbered")

    def summed_up(table: pa.Table) -> pa.Table:
        _, _, observed = _lines_of(table, block)
        if not observed:  # the conversation ended with the block before
            return _matrix_row(table, 0, np.zeros(0)).slice(0, 0)
        return _matrix_row(table, table.column("idx")[0].as_py(), model.matrix(observed))

    scheme = f"conv {kind}, idx long, matrix array<double>"
    levels = [stage(_grouped(rows, ["conv", "idx"], summed_up, scheme), "matrices")]
    # Blocks without lines leave gaps; only the order of the others counts.
    while (levels[-1].agg(F.max("idx") - F.min("idx")).first()[0] or 0) >= fan:
        upper = levels[-1].withColumn("up", F.floor(F.col("idx") / fan).cast("long"))

        def multiplied(table: pa.Table) -> pa.Table:
            return _matrix_row(table, table.column("up")[0].as_py(), _product_of(_matrices(table)[1]))

        levels.append(stage(_grouped(upper, ["conv", "up"], multiplied, scheme), "matrices"))

    def top(table: pa.Table) -> pa.Table:
        order, matrices = _matrices(table)
        return _border_rows(table, order, borders(matrices, BEFORE, None))

    def inner(table: pa.Table) -> pa.Table:
        order, matrices = _matrices(table)
        return _border_rows(table, order, borders(matrices, table.column("begin")[0].as_py(), table.column("end")[0].as_py()))

    marks = f"conv {kind}, idx long, begin int, end int"
    # Conversations apart from those that hold the largest span have one group at the top as well.
    bounds = _grouped(levels[-1].withColumn("up", F.lit(0)), ["conv"], top, marks)
    for level in reversed(levels[:-1]):
        told = bounds.withColumnsRenamed({"idx": "up", "conv": "_conv"})
        lower = level.withColumn("up", F.floor(F.col("idx") / fan).cast("long"))
        lower = lower.join(told, lower["conv"].eqNullSafe(told["_conv"]) & (lower["up"] == told["up"])).select(
            "conv", "idx", "matrix", lower["up"], "begin", "end")
        bounds = _grouped(lower, ["conv", "up"], inner, marks)
    told = stage(bounds, "borders").withColumnsRenamed({"idx": "_idx", "conv": "_conv"})
    known = rows.join(told, rows["conv"].eqNullSafe(told["_conv"]) & (rows["idx"] == told["_idx"])).select(
        "conv", "idx", *at, "number", "line", "begin", "end")

    def labelled(table: pa.Table) -> pa.Table:
        table, texts, observed = _lines_of(table, block)
        states = model.path(observed, table.column("begin")[0].as_py(), table.column("end")[0].as_py())
        opens = [s % 2 == 0 for s in states]
        roles = [ROLES[s // 2] for s in states]
        shown = [f"<|{r}|>\n{x[marker_of(x)[1]:]}" if o else x for r, o, x in zip(roles, opens, texts)]
        return pa.table({"conv": table.column("conv"), **{p: table.column(p) for p in at},
                         "number": table.column("number"), "role": pa.array(roles, pa.string()),
                         "opens": pa.array(opens, pa.bool_()), "rendered": pa.array(shown, pa.string())})

    out = _grouped(known, ["conv", "idx"], labelled, f"conv {kind}, {', '.join(f'{p} long' for p in at)}, number long, role string, opens boolean, rendered string")
    return out.select(F.col("conv").alias(conv_id), *[F.col(p).alias(name) for p, name in zip(at, named)],
                      "number", "role", "opens", "rendered")


def _matrix_row(table: pa.Table, at: int, matrix: np.ndarray) -> pa.Table:
    return pa.table({"conv": table.column("conv").slice(0, 1), "idx": pa.array([at], pa.int64()),
                     "matrix": pa.array([matrix.ravel().tolist()], pa.list_(pa.float64()))})


def _matrices(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.sort_by("idx")
    return table, [np.array(m).reshape(STATES + 1, STATES + 1) for m in table.column("matrix").to_pylist()]


def _product_of(matrices: list[np.ndarray]) -> np.ndarray:
    total = matrices[0]
    for m in matrices[1:]:
        total = product(total, m)
    return total


def _border_rows(table: pa.Table, order: pa.Table, found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"conv": order.column("conv"), "idx": order.column("idx"),
                     "begin": pa.array([b for b, _ in found], pa.int32()), "end": pa.array([e for _, e in found], pa.int32())})


def render(parsed: DataFrame, conv_id: str = "conv_id", position: str = "number", block: int = BLOCK) -> DataFrame:
    """Rendered text of every block of a conversation; blocks in their order are the conversation."""
    rows = parsed.select(
        F.col(conv_id), F.floor(F.coalesce(F.col(position), F.lit(0)) / block).alias("block"),
        F.struct(F.col(position).alias("p"), F.col("rendered").alias("r")).alias("_x"))
    return rows.groupBy(conv_id, "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["r"]), "\n").alias("text"))
