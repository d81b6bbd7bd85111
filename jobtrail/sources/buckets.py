"""A ledger on files, bucketed by key: batches add rows, or rewrite the buckets they touch and no others."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtrail.operators import keys as K

BUCKET = "_bucket"


class BucketLedger:
    """Rows under ``data/batch=<n>/_bucket=<b>``; ``commits/<n>`` names the folders that make up the table after batch n.

    Batches are numbered upwards, by one writer at a time. A batch writes new folders and never touches old ones; the table
    changes when its commit file is renamed into place. So readers always see whole batches, a batch that died is
    run again over its own folder, and a batch that is committed already does nothing. A commit holds
    one line per bucket and batch added since the bucket was last rewritten; ``merge`` brings the buckets it touches
    back to one. NULL keys share a bucket and are neither updated nor deleted. An emptied bucket has no folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.schema("key string, buckets int, columns string").json(f"{path}/table").first()
        self.key, self.buckets = head.key, head.buckets
        self.schema = StructType.fromJson(json.loads(head.columns))

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 256) -> BucketLedger:
        """A new ledger holding ``rows`` as batch 0. Choose buckets of some hundred megabytes each."""
        if key not in rows.columns:
            raise ValueError(f"no column {key}")
        if buckets < 1:
            raise ValueError("buckets must be positive")
        spark = rows.sparkSession
        head = spark.range(1).select(
            F.lit(key).alias("key"), F.lit(buckets).alias("buckets"), F.lit(rows.schema.json()).alias("columns"))
        head.coalesce(1).write.mode("overwrite").json(f"{path}/table")
        ledger = cls(spark, path)
        ledger.append(rows, 0)
        return ledger

    def read(self) -> DataFrame:
        return self._read(self.folders())

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add rows; no present file is read."""
        if batch > self.version():
            written = self._write(rows.select(*self.schema.names), batch)
            self._commit(batch, self.folders() + [(b, batch) for b in written])

    def merge(self, batch: int, updates: DataFrame | None = None, cols: Sequence[str] = (), order: Sequence[str] = (),
              deletes: DataFrame | None = None) -> None:
        """Set ``cols`` from the latest update of each key, then delete keys; only buckets of these keys are read and written."""
        if batch <= self.version():
            return
        changed = [d.select(self.key) for d in (updates, deletes) if d is not None]
        touched = {b for d in changed for b in self._buckets_of(d)}
        old = self.folders()
        rows = self._read([f for f in old if f[0] in touched])
        if updates is not None:
            rows = K.apply_updates(rows, updates, self.key, cols, order)
        if deletes is not None:
            rows = K.apply_deletes(rows, deletes, self.key)
        written = self._write(rows, batch) if touched else []
        self._commit(batch, [f for f in old if f[0] not in touched] + [(b, batch) for b in written])

    def vacuum(self, keep: int = 2) -> None:
        """Delete commits older than the last ``keep``, and the batches that no kept commit names."""
        versions = self._versions()
        kept = versions[-max(keep, 1):]
        live = {batch for v in kept for _, batch in self.folders(v)}
        for v in versions:
            if v not in kept:
                self._files(f"commits/{v}", lambda fs, p: fs.delete(p, True))
                if v not in live:
                    self._files(f"data/batch={v}", lambda fs, p: fs.delete(p, True))
            elif v not in live and v != kept[-1]:
                self._files(f"data/batch={v}", lambda fs, p: fs.delete(p, True))

    def bucket(self) -> Column:
        return F.pmod(F.hash(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """Last committed batch, -1 for none."""
        return max(self._versions(), default=-1)

    def folders(self, version: int | None = None) -> list[tuple[int, int]]:
        """(bucket, batch) of every folder of the table."""
        version = self.version() if version is None else version
        if version < 0:
            return []
        commit = self.spark.read.text(f"{self.path}/commits/{version}", wholetext=True).first()
        lines = map(json.loads, commit.value.splitlines()) if commit else ()
        return sorted((line["bucket"], line["batch"]) for line in lines)

    def _read(self, folders: list[tuple[int, int]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(
            *[f"{self.path}/data/batch={n}/{BUCKET}={b}" for b, n in folders])

    def _write(self, rows: DataFrame, batch: int) -> list[int]:
        path = f"{self.path}/data/batch={batch}"
        rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)

        def written(fs, path):
            names = [s.getPath().getName() for s in fs.listStatus(path)]
            return [int(n.partition("=")[2]) for n in names if n.startswith(f"{BUCKET}=")]

        return self._files(f"data/batch={batch}", written)

    def _buckets_of(self, keys: DataFrame) -> list[int]:
        """Different buckets of the keys as one row, never more than the ledger has."""
        return keys.select(self.bucket().alias(BUCKET)).distinct().agg(F.collect_list(BUCKET)).first()[0]

    def _commit(self, batch: int, folders: list[tuple[int, int]]) -> None:
        text = "".join(json.dumps({"bucket": b, "batch": n}) + "\n" for b, n in folders)

        def put(fs, path):
            part = self.spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_{batch}")
            out = fs.create(part, True)
            out.write(bytearray(text.encode()))
            out.close()
            if not fs.rename(part, path):
                raise OSError(f"batch {batch} could not be committed")

        self._files(f"commits/{batch}", put)

    def _versions(self) -> list[int]:
        def names(fs, path):
            return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

        return sorted(int(n) for n in self._files("commits", names) if n.isdigit())

    def _files(self, name: str, use):
        """``use(file system, path)`` for a path below the ledger's."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return use(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path)
