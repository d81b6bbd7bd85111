"""A keyed table that streams update: deltas per batch, merged into snapshots now and then.

Under ``path`` lie ``delta/<batch>``, ``snapshot/<batch>`` and ``pointer/<batch>``. A batch writes one delta
of the keys it touched. Every ``compact_every`` batches the last snapshot and the deltas after it
are merged into a new snapshot (or a stream that has the whole state at hand puts it there), and an empty pointer file with its number, made by one create call, says
that it is whole; a snapshot without pointer does not exist for readers. What lies before the snapshot
before is removed then, so a reader opens one snapshot and fewer than ``2 * compact_every`` deltas however
long the stream runs, and one that began before a compaction still finds its files.

A retried batch reads what was there before it (pointers and deltas below its number) and overwrites its own
directories, so a retry changes nothing, whether the first try ended before or after the pointer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """``order`` columns settle which of two rows of a key is the latest; the later batch decides ties.

    Rows that no batch has touched for ``keep_batches`` batches are dropped when a snapshot is made.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: Sequence[str] = (), compact_every: int = 10,
                 keep_batches: int | None = None):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, list(order)
        self.compact_every, self.keep_batches = compact_every, keep_batches

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """One row per touched key; rows with a true ``_gone`` delete their key. Returns the rows as they are stored."""
        if "_gone" not in rows.columns:
            rows = rows.withColumn("_gone", F.lit(False))
        path = f"{self.path}/delta/{batch_id}"
        rows = rows.withColumn("_batch", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if self.due(batch_id):
            self.compact(batch_id)
        return self.spark.read.schema(rows.schema).parquet(path)

    def due(self, batch_id: int) -> bool:
        """Whether a batch ends in a snapshot."""
        return (batch_id + 1) % self.compact_every == 0

    def read(self, before: int | None = None) -> DataFrame | None:
        """Latest row of every key after all batches below ``before``; None if there was none."""
        open_rows = self.open(before)
        return None if open_rows is None else open_rows.drop("_batch")

    def open(self, before: int | None = None) -> DataFrame | None:
        """What :meth:`read` gives, and in ``_batch`` the batch that touched each row last."""
        merged = self._merged(before)
        return None if merged is None else merged.filter("not _gone").drop("_gone")

    def compact(self, batch_id: int) -> None:
        self.replace(self.open(batch_id + 1), batch_id)

    def replace(self, state: DataFrame, batch_id: int) -> None:
        """Make ``state``, rows of :meth:`open` after the batch, its snapshot; such a batch needs no delta."""
        if self.keep_batches is not None:
            state = state.filter(F.col("_batch") > batch_id - self.keep_batches)
        state.withColumn("_gone", F.lit(False)).write.mode("overwrite").option("compression", "zstd").parquet(
            f"{self.path}/snapshot/{batch_id}")
        self._point(batch_id)
        kept = [b for b in self._numbers("pointer") if b < batch_id]
        if kept:
            for kind in ("delta", "snapshot", "pointer"):
                for b in self._numbers(kind):
                    if b < kept[-1] or (b == kept[-1] and kind == "delta"):
                        self._files(f"{kind}/{b}", lambda fs, p: fs.delete(p, True))

    def sources(self, before: int | None = None) -> list[str]:
        """Directories that hold the state after all batches below ``before``."""
        limit = float("inf") if before is None else before
        whole = [b for b in self._numbers("pointer") if b < limit]
        since = whole[-1] if whole else -1
        deltas = [f"{self.path}/delta/{b}" for b in self._numbers("delta") if since < b < limit]
        return [f"{self.path}/snapshot/{since}"] * bool(whole) + deltas

    def _merged(self, before: int | None) -> DataFrame | None:
        paths = self.sources(before)
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        values = [c for c in rows.columns if c != self.key]
        # One aggregate with map-side combine: many deltas of one key cost one row a task.
        latest = F.max_by(F.struct(*values), F.struct(*self.order, "_batch")).alias("_row")
        return rows.groupBy(self.key).agg(latest).select(self.key, "_row.*")

    def _point(self, batch_id: int) -> None:
        self._files(f"pointer/{batch_id}", lambda fs, p: fs.create(p, True).close())

    def _numbers(self, kind: str) -> list[int]:
        found = self._files(kind, lambda fs, p: list(fs.listStatus(p)) if fs.exists(p) else [])
        return sorted(int(f.getPath().getName()) for f in found)

    def _files(self, name: str, use):
        """``use`` with the file system of the store and a path in it, whatever store that is."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return use(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path)
