"""A streaming source of lines of text files that grow.

Spark's file source reads a file once. This one remembers how many bytes of each file it has read. The
offset of a batch is ``{file: bytes}``; between two offsets lie byte ranges, which are read as tasks of at
most ``split_bytes``. A line belongs to the range that holds its line end. A task therefore first looks
back for the start of the line its range begins in; the unfinished line at the end of a file is
left to the range that will hold its end. So each line comes once, however appends, triggers, restarts
and splits cut the files, and a retried batch reads the same ranges again.

The driver lists the folder and keeps one number a file, so closed logs should move out of a followed
folder in time (per date, say). A file that shrinks is not read again before it has grown past its old size.
Files are opened with ``pyarrow.fs``: local, HDFS, S3 and GCS addresses work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes read at a time.
BLOCK = 4 << 20


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int

    def __post_init__(self):
        super().__init__(None)


class LogTail(DataSource):
    """Format ``log_tail``: rows (file, at, line), where ``at`` is the byte a line starts at."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"], int(self.options.get("split_bytes", 64 << 20)))


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.is_file and f.size and f.base_name[0] not in "._"}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for file, size in sorted(end.items()):
            for begin in range(start.get(file, 0), size, self.split_bytes):
                ranges.append(Range(file, begin, min(size, begin + self.split_bytes)))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.file) as source:
            for places, lines in lines_ending_in(source, partition.begin, partition.end):
                yield pa.RecordBatch.from_arrays([
                    pa.array([partition.file] * len(lines), pa.string()), pa.array(places, pa.int64()),
                    pa.array([x.removesuffix(b"\r").decode(errors="replace") for x in lines], pa.string()),
                ], names=["file", "at", "line"])

    def commit(self, end: dict) -> None:
        pass


def lines_ending_in(source, begin: int, end: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Lines whose end lies in the bytes from ``begin`` to ``end``, with the places they start at."""
    at = _line_start(source, begin)
    rest: list[bytes] = []  # pieces of the line that is open
    place, size = at, at
    while size < end:
        source.seek(size)
        data = source.read(min(BLOCK, end - size))
        if not data:
            return  # the file has become shorter
        size += len(data)
        *whole, last = data.split(b"\n")
        if whole:
            whole[0] = b"".join([*rest, whole[0]])
            places = [place]
            for line in whole[:-1]:
                places.append(places[-1] + len(line) + 1)
            yield places, whole
            place, rest = places[-1] + len(whole[-1]) + 1, []
        rest.append(last)


def _line_start(source, at: int) -> int:
    while at:
        begin = max(0, at - BLOCK)
        source.seek(begin)
        found = source.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def tail(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Stream of the lines of all files below ``path``, those that are still written to included."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("split_bytes", str(split_bytes)).load()
