"""Aggregated container logs, read by byte ranges.

A section holds as many bytes as its header states, so whether a line is a header depends on all
headers before it. For one range of a file this is a function: from the place up to which a section is open
on entry to the place up to which one is open on exit, the sections and lines between, and the
section and container in force. Such functions compose. So

1. every range is scanned once and leaves one small row: what it does when no section is open on entry, and
   the places behind it where a candidate for a header in it may end,
2. such places of earlier ranges are the only entries a range can meet; its function is a table over them, and
   a range that has any is read once more for it,
3. tables of :data:`FAN` neighbouring ranges are composed to one, level by level, until a file has at
   most :data:`FAN`; going down again gives every range the state it is entered with,
4. every range is read again and cuts its own lines.

Neither the text nor the candidates move between tasks or are staged; no step gathers a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from jobtrail import constants as C
from jobtrail.session import stage

#: Ranges (or composed groups of them) that one task composes.
FAN = 1024
#: Bytes read at a time, and lines in one batch of the result.
BLOCK, BATCH = 4 << 20, 1 << 16
#: Least size of a range, unless ``spark.sql.files.maxPartitionBytes`` is smaller.
LEAST_RANGE = 4 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
ENDLESS = 1 << 62

_LONG, _TEXT = pa.int64(), pa.string()
_HOME = pa.struct([("container", _TEXT), ("node", _TEXT)])
_SECTION = pa.struct([("begin", _LONG), ("end", _LONG), ("log_type", _TEXT), ("log_length", _LONG), ("line", _LONG)])
#: What a range does to the state: place open on exit, sections, container in force, last section and the
#: container in force at it (NULL: the one in force on entry).
_EFFECT = pa.struct([("entry", _LONG), ("exit", _LONG), ("sections", _LONG), ("home", _HOME), ("last", _SECTION),
                     ("last_home", _HOME)])
SCANNED = pa.schema([
    ("file", _TEXT), ("unit", _LONG), ("begin", _LONG), ("end", _LONG), ("file_bytes", _LONG), ("lines", _LONG),
    ("effect", _EFFECT), ("places", pa.list_(_LONG))])
TABLES = pa.schema([
    ("file", _TEXT), ("unit", _LONG), ("begin", _LONG), ("end", _LONG), ("lines", _LONG),
    ("entries", pa.list_(pa.struct([("place", _LONG), ("origin", _LONG)]))), ("effects", pa.list_(_EFFECT))])
STATES = pa.schema([
    ("file", _TEXT), ("unit", _LONG), ("open", _LONG), ("sections", _LONG), ("home", _HOME), ("last", _SECTION),
    ("last_home", _HOME), ("lines_before", _LONG)])
LINES = pa.schema([
    ("file", _TEXT), ("node", _TEXT), ("container", _TEXT), ("section", pa.int32()), ("log_type", _TEXT),
    ("log_length", _LONG), ("line_no", _LONG), ("line", pa.binary())])

_STAMP = C.STAMP_PATTERN.encode() + rb"\t"
_MARK = re.compile(rb"^(?:" + _STAMP + rb"LogType: *$|Container: (\S+) on (\S+)\r?$)", re.M)
_HEADER = re.compile(
    _STAMP + rb"LogType: *\n" + _STAMP + rb"([^\n]*)\n" + _STAMP + rb" *LogLength: *\n"
    + _STAMP + rb"[ \t\r]*\+?([0-9]+)[ \t\r]*\n" + _STAMP + rb" *Log Contents: *(?:\n|\Z)")


def read_container_logs(spark: SparkSession, path: str, range_bytes: int | None = None, fan: int = FAN) -> DataFrame:
    """Lines of aggregated container logs with the section each belongs to.

    Columns: file, node, container, section (number within the file), log_type, log_length,
    line_no (within the section) and line. One row per line instead of one per section, so no
    section has to fit in a row and no file in a task. A section holds ``log_length`` bytes after its
    header, whatever they look like; what looks like a header inside them is text. A section
    without any text is one row with ``line_no`` 0 and a NULL line. Empty files give no row.

    Files are opened with ``pyarrow.fs``: local, HDFS, S3 and GCS addresses work. Compressed files (gz, bz2,
    zst, lz4) are one range each, read as a stream. Ranges are cut when this is called; ``range_bytes`` is
    their size, by default what ``spark.sql.files.maxPartitionBytes`` and the number of cores suggest.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.select(F.col("path").alias("file"), "length").filter("length > 0")
    total, largest = found.agg(F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    size = range_bytes or min(_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")),
                              max(LEAST_RANGE, -(-total // (4 * cores))))
    tasks = max(4 * cores, -(-total // max(size, LEAST_RANGE)))

    packed = F.lower("file").rlike("(" + "|".join(re.escape(e) for e in COMPRESSED) + ")$")
    last = F.when(packed, 0).otherwise(((F.col("length") - 1) / size).cast("bigint"))
    ranges = found.select("file", packed.alias("packed"), "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("unit"))
    ranges = ranges.select(
        "file", "unit", F.when(F.col("packed"), 0).otherwise(F.col("unit") * size).alias("begin"),
        F.when(F.col("packed"), ENDLESS).otherwise(F.least((F.col("unit") + 1) * size, "length")).alias("end"),
        F.when(~F.col("packed"), F.col("length")).alias("file_bytes"))
    scanned = stage(ranges.repartition(tasks, "file", "unit").mapInArrow(_scan, from_arrow_schema(SCANNED)), "log-ranges")

    units = -(-largest // size)
    levels = [stage(_tables(scanned, size, tasks), "log-tables")]
    while units > fan:
        levels.append(stage(_composed(levels[-1], fan), "log-tables"))
        units = -(-units // fan)
    state = None
    for level in reversed(levels):
        state = stage(_entered(level, state, fan), "log-states")
    placed = scanned.drop("effect", "places").join(state, ["file", "unit"]).repartition(tasks, "file", "unit")
    return placed.mapInArrow(_cut, from_arrow_schema(LINES)).withColumn("line", F.col("line").cast("string"))


def _tables(scanned: DataFrame, size: int, tasks: int) -> DataFrame:
    """The function of every range, over the places where sections of earlier ranges may end in it."""
    entries = (
        scanned.select("file", "unit", F.explode("places").alias("place"))
        .groupBy("file", "place").agg(F.min("unit").alias("origin"))
        .groupBy("file", (F.col("place") / size).cast("bigint").alias("unit"))
        .agg(F.collect_list(F.struct("place", "origin")).alias("entries"))
    )
    rows = scanned.drop("places").join(entries, ["file", "unit"], "left").withColumn(
        "entries", F.coalesce("entries", F.array().cast("array<struct<place: bigint, origin: bigint>>")))
    return rows.repartition(tasks, "file", "unit").mapInArrow(_tabulate, from_arrow_schema(TABLES))


def _composed(tables: DataFrame, fan: int) -> DataFrame:
    """One table for each ``fan`` neighbouring ones."""
    def compose(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["unit"])
        file, unit = key[0].as_py(), key[1].as_py()
        outer = [{"place": e["place"], "origin": e["origin"] // fan}
                 for r in rows for e in r["entries"] if e["origin"] // fan != unit]
        effects = []
        for place in sorted({0, *(e["place"] for e in outer)}):
            state = _start(place)
            for r in rows:
                state = _step(state, r)
            effects.append({"entry": place, "exit": state["open"], **{k: state[k] for k in ("sections", "home", "last", "last_home")}})
        return pa.Table.from_pylist([{
            "file": file, "unit": unit, "begin": rows[0]["begin"], "end": rows[-1]["end"],
            "lines": sum(r["lines"] for r in rows), "entries": outer, "effects": effects}], TABLES)

    return tables.groupBy("file", (F.col("unit") / fan).cast("bigint").alias("_group")).applyInArrow(compose, from_arrow_schema(TABLES))


def _entered(tables: DataFrame, above: DataFrame | None, fan: int) -> DataFrame:
    """The state every range is entered with, from the state its group is entered with."""
    fields, top = STATES.names[2:], above is None

    def enter(key: tuple, group: pa.Table) -> pa.Table:
        rows, out = sorted(group.to_pylist(), key=lambda r: r["unit"]), []
        state = _start(0) if top else {k: rows[0][k] for k in fields}
        for r in rows:
            out.append({"file": r["file"], "unit": r["unit"], **state})
            state = _step(state, r)
        return pa.Table.from_pylist(out, STATES)

    rows = tables.withColumn("_group", (F.col("unit") / fan).cast("bigint"))
    if not top:
        rows = rows.join(above.withColumnRenamed("unit", "_group"), ["file", "_group"])
    return rows.groupBy("file", "_group").applyInArrow(enter, from_arrow_schema(STATES))


def _start(place: int) -> dict:
    return {"open": place, "sections": 0, "home": None, "last": None, "last_home": None, "lines_before": 0}


def _step(state: dict, table: dict) -> dict:
    """The state behind a range (or a group of ranges) that is entered with ``state``."""
    lines = state["lines_before"]
    if state["open"] >= table["end"]:  # all of it is text of one section
        return {**state, "lines_before": lines + table["lines"]}
    entry = state["open"] if state["open"] > table["begin"] else 0
    effect = next(e for e in table["effects"] if e["entry"] == entry)
    after = {**state, "open": effect["exit"], "sections": state["sections"] + effect["sections"],
             "home": effect["home"] or state["home"], "lines_before": lines + table["lines"]}
    if effect["last"]:
        after["last"] = {**effect["last"], "line": lines + effect["last"]["line"]}
        after["last_home"] = effect["last_home"] or state["home"]
    return after


def _candidates(pos: int, data: bytes, n: int, line: int, start: int = 0) -> Iterator[tuple[int, dict | None, dict | None]]:
    """Container lines and candidates for headers in a block, as (place, container or None, section or None).

    ``line`` is the number of the first line of the block.
    """
    seen = 0
    for m in _MARK.finditer(data, start, n):
        line, seen = line + data.count(b"\n", seen, m.start()), m.start()
        if m[1] is not None:
            yield pos + seen, {"container": _text(m[1]), "node": _text(m[2])}, None
            continue
        header = _HEADER.match(data, seen)
        length = int(header[2]) if header and len(header[2]) < 40 else ENDLESS * 2
        if length < ENDLESS * 2:
            begin = pos + header.end()
            yield pos + seen, None, {"begin": begin, "end": min(begin + length, ENDLESS), "log_type": _text(header[1]),
                                     "log_length": length, "line": line}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of every range, what it does when no section is open on entry, and the places that candidates in it reach."""
    for row in _rows(batches):
        lines, size, places = 0, row["begin"], set()
        effect = {"entry": 0, "exit": 0, "sections": 0, "home": None, "last": None, "last_home": None}
        for pos, data, n in _blocks(row["file"], row["begin"], row["end"]):
            for at, home, section in _candidates(pos, data, n, lines):
                if section and row["end"] < section["end"]:
                    places.add(section["end"])
                if at < effect["exit"]:
                    continue
                if home:
                    effect["home"] = home
                else:
                    effect.update(exit=section["end"], sections=effect["sections"] + 1, last=section, last_home=effect["home"])
            lines += data.count(b"\n", 0, n) + (data[n - 1] != 10)
            size = pos + n
        bytes_ = size if row["file_bytes"] is None else row["file_bytes"]
        yield pa.RecordBatch.from_pylist([{
            **row, "file_bytes": bytes_, "lines": lines, "effect": effect, "places": [p for p in places if p < bytes_]}], SCANNED)


def _tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of every range over the places it may be entered with."""
    for row in _rows(batches):
        places = sorted(e["place"] for e in row["entries"] if e["place"] > row["begin"])
        yield pa.RecordBatch.from_pylist([{
            **{k: row[k] for k in ("file", "unit", "begin", "end", "lines", "entries")},
            "effects": [row["effect"], *(_effects(row, places) if places else [])]}], TABLES)


def _effects(row: dict, places: list[int]) -> list[dict]:
    """From the last candidate back: what follows when a candidate is a section, then what follows an entry."""
    marks, lines = [], 0
    for start, data, n in _blocks(row["file"], row["begin"], row["end"]):
        marks.extend(_candidates(start, data, n, lines))
        lines += data.count(b"\n", 0, n)
    pos, is_head = np.array([m[0] for m in marks], np.int64), np.array([m[1] is None for m in marks], bool)
    heads, homes = np.flatnonzero(is_head), np.flatnonzero(~is_head)
    head_at, home_at = pos[heads], pos[homes]
    head_end = np.array([marks[i][2]["end"] for i in heads], np.int64)
    none = len(heads)

    def behind(places: np.ndarray) -> tuple[list, list]:
        """The first candidate from a place on, and the last container line before it (or -1)."""
        following = np.searchsorted(head_at, places)
        near = np.searchsorted(home_at, np.append(head_at, ENDLESS)[following]) - 1
        inside = np.append(home_at, -1)[near] >= places
        return following.tolist(), np.where(inside & (near >= 0), near, -1).tolist()

    following, near = behind(head_end)
    after: list[tuple | None] = [None] * none  # exit, sections, container line, last section, container line before it
    for i in range(none - 1, -1, -1):
        if following[i] == none:
            after[i] = (int(head_end[i]), 1, near[i], i, -1)
        else:
            end, count, home, last, last_home = after[following[i]]
            after[i] = (end, count + 1, near[i] if home < 0 else home, last, near[i] if last_home < 0 else last_home)

    def effect(place: int, i: int, near: int) -> dict:
        end, count, home, last, last_home = (place, 0, -1, -1, -1) if i == none else after[i]
        home, last_home = near if home < 0 else home, near if last_home < 0 and i < none else last_home
        return {"entry": place, "exit": end, "sections": count,
                "home": marks[homes[home]][1] if home >= 0 else None,
                "last": marks[heads[last]][2] if last >= 0 else None,
                "last_home": marks[homes[last_home]][1] if last_home >= 0 else None}

    return [effect(*x) for x in zip(places, *behind(np.array(places, np.int64)))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the sections in every range."""
    for row in _rows(batches):
        labels, counts, numbers, texts = [], [], [], []  # of sections; of lines

        def batch() -> pa.RecordBatch:
            """The lines so far; what the lines of a section share is repeated here."""
            which = pa.array(np.repeat(np.arange(len(labels)), counts))
            shared = [pa.array(c, f.type).take(which) for c, f in zip(zip(*labels), list(LINES)[1:6])]
            made = pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(row["file"]), len(texts)), *shared,
                pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())], schema=LINES)
            for part in (labels, counts, numbers, texts):
                part.clear()
            return made

        line, place, number, home = row["lines_before"], row["open"], row["sections"], row["home"]
        sections = []  # whose text may go on: (begin, end, label, line of the header)
        if place > row["begin"]:
            sections.append(_section(row["last"], row["last_home"], number))
        for pos, data, n in _blocks(row["file"], row["begin"], row["end"]):
            for at, found, section in _candidates(pos, data, n, line, max(0, min(place - pos, n))):
                if at < place:
                    continue
                if found:
                    home = found
                    continue
                number, place = number + 1, section["end"]
                sections.append(_section(section, home, number))
                if section["begin"] == place or section["begin"] >= row["file_bytes"]:
                    labels.append(sections.pop()[2])
                    counts.append(1)
                    numbers.append(0)
                    texts.append(None)
            for begin, end, label, head in sections:
                first, stop = max(begin, pos), min(end, pos + n)
                if first < stop:
                    lines = data[first - pos:stop - pos].split(b"\n")
                    if not lines[-1]:
                        lines.pop()
                    first_no = 1 if first == begin else line - head - 4
                    labels.append(label)
                    counts.append(len(lines))
                    numbers.extend(range(first_no, first_no + len(lines)))
                    texts.extend(lines)
                    if len(texts) >= BATCH:
                        yield batch()
            sections = [x for x in sections if x[1] > pos + n]
            line += data.count(b"\n", 0, n)
        if texts:
            yield batch()


def _section(section: dict, home: dict | None, number: int) -> tuple:
    """(begin, end, (node, container, number, type, length), line of the header)"""
    home = home or {"node": None, "container": None}
    return section["begin"], section["end"], (
        home["node"], home["container"], number, section["log_type"], section["log_length"]), section["line"]


def _blocks(file: str, begin: int, end: int) -> Iterator[tuple[int, bytes, int]]:
    """Whole lines that start between ``begin`` and ``end``, in blocks (place, data, n).

    The lines are ``data[:n]``; at least four more lines follow in ``data`` unless the file ends.
    """
    with _open(file) as source:
        pos = begin
        if begin:
            source.seek(begin - 1)
            at, pos = begin - 1, None
            while pos is None and at < end - 1:
                data = source.read(min(BLOCK, end - 1 - at))
                if not data:
                    return
                found = data.find(b"\n")
                pos = at + found + 1 if found >= 0 else None
                at += len(data)
            if pos is None:
                return  # no line starts here
            source.seek(pos)
        rest = b""
        while pos < end:
            data = source.read(max(BLOCK, len(rest)))
            rest, over, n = rest + data, not data, 0
            if over:
                n = len(rest)
            else:
                cut = len(rest)
                for _ in range(5):
                    cut = rest.rfind(b"\n", 0, cut)
                    if cut < 0:
                        break
                n = cut + 1
            if pos + n > end:
                last = rest.find(b"\n", end - pos - 1, n)
                n = last + 1 if last >= 0 else n
            if n:
                yield pos, rest, n
                pos, rest = pos + n, rest[n:]
            if over:
                return


def _open(file: str):
    scheme, _, rest = file.partition(":")
    if scheme == "file":
        system, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        host, _, name = rest[2:].partition("/")
        system, root = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host}/")
        name = f"{root.rstrip('/')}/{name}"
    return system.open_input_stream(name) if file.lower().endswith(COMPRESSED) else system.open_input_file(name)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _text(data: bytes) -> str:
    return data.decode(errors="replace")


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"([0-9]+)([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")
