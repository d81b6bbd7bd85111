"""Following logs and ledgers as streams.

Each stream has a batch twin with the same result: ``extract_app_ids``, ``number_apps`` with
``app_intervals``, and ``apply_updates``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtrail.functions.parsing import extract_app_ids
from jobtrail.operators.keys import apply_updates
from jobtrail.operators.ordered import GROUP_LIMIT, group_bound, join_keys, sequence_rows
from jobtrail.session import stage
from jobtrail.sources.logs import task_lines
from jobtrail.streaming.store import KeyedStore
from jobtrail.streaming.tail import tail


def stream_app_ids(spark: SparkSession, path: str, strict: bool = False,
                   max_files: int | None = None) -> DataFrame:
    """Submissions of closed task logs as their files appear (layout of ``read_task_logs``). Stateless.

    A file is read once, so lines appended to it later are not seen: move a log here when it is
    complete, or write it as closed segments.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return extract_app_ids(task_lines(lines), strict).select("otid", "opid", "stream", "log_date", "appid")


def stream_growing_app_ids(spark: SparkSession, path: str, strict: bool = False, split_bytes: int = 64 << 20) -> DataFrame:
    """Submissions of task logs that are still written to, each once, as soon as its line is complete."""
    lines = task_lines(tail(spark, path, split_bytes))
    return extract_app_ids(lines, strict).select("otid", "opid", "stream", "log_date", "at", "appid")


def stream_tasks(events: DataFrame, path: str, checkpoint: str, order: Sequence[str], compact_every: int = 10,
                 keep_batches: int | None = None) -> StreamingQuery:
    """Outcome of each task when it ends: how many applications it had, and the last one.

    ``events`` are submissions (otid, stream, appid and the order columns) and ends of tasks (otid, stream
    ``end`` and the column submission). Applications on stdout wait for the end of their task: they count if it is a
    sync task without any on stderr. An ended task gives one row under ``<path>/ended/batch=<id>`` and
    leaves the state, so state follows the open tasks; tasks that no batch touches for ``keep_batches`` leave it
    without an outcome. A batch is aggregated before it meets the state, so a busy task is one row by then.
    A submission that arrives after the end of its task is not counted.
    """
    order = list(order)

    def found(stream: str) -> F.Column:
        return (F.col("stream") == stream) & F.col("appid").isNotNull()

    def settle(batch: DataFrame, batch_id: int) -> None:
        store = KeyedStore(batch.sparkSession, f"{path}/open", "otid", compact_every=compact_every, keep_batches=keep_batches)
        touched = batch.groupBy("otid").agg(
            F.count_if(found("stderr")).alias("n_err"), F.max(F.when(found("stderr"), F.struct(*order, "appid"))).alias("last_err"),
            F.count_if(found("stdout")).alias("n_out"), F.max(F.when(found("stdout"), F.struct(*order, "appid"))).alias("last_out"),
            F.max(F.when(F.col("stream") == "end", F.col("submission"))).alias("submission"),
            F.coalesce(F.bool_or(F.col("stream") == "end"), F.lit(False)).alias("_gone"))
        whole, known = store.due(batch_id), store.open(batch_id)
        touched = touched.withColumn("_batch", F.lit(batch_id).cast("bigint"))
        if known is not None:
            zero = F.lit(0).cast("bigint")
            merged = {n: F.coalesce(n, zero) + F.coalesce(f"_{n}", zero) for n in ("n_err", "n_out")}
            merged |= {n: F.greatest(n, f"_{n}") for n in ("last_err", "last_out")}
            merged |= {"_gone": F.coalesce("_gone", F.lit(False)), "_batch": F.coalesce("_batch", "__batch")}
            old = known.select("otid", *[F.col(n).alias(f"_{n}") for n in ("n_err", "n_out", "last_err", "last_out", "_batch")])
            # Where a snapshot is due, rows that the batch does not touch come along: the state is not merged a second time.
            touched = touched.join(old, "otid", "full" if whole else "left").withColumns(merged).select(*touched.columns)
        if whole:
            rows = stage(touched, "touched", "zstd")
            store.replace(rows.filter("not _gone").drop("_gone"), batch_id)
        else:
            rows = store.write(touched.drop("_batch"), batch_id)
        fallback = (F.col("n_err") == 0) & (F.col("submission") == "sync")
        rows.filter("_gone").select(
            "otid", F.when(F.col("n_err") > 0, F.col("n_err")).when(fallback, F.col("n_out")).otherwise(0).alias("n_apps"),
            F.when(F.col("n_err") > 0, F.col("last_err.appid")).when(fallback, F.col("last_out.appid")).alias("last_appid"),
        ).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/ended/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(settle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_ledger(ids: DataFrame, path: str, checkpoint: str, order: Sequence[str],
                  snapshot_every: int = 50, group_limit: int = GROUP_LIMIT) -> StreamingQuery:
    """Number the applications of each task as their submissions arrive.

    Each micro-batch appends ``ledger/batch=<id>`` under ``path`` (task, sequence, appid and the
    order columns). Numbering inside a batch is the distributed one of the batch twin, so one busy task
    does not hold a batch up; the last number of each task before shifts it. Every ``snapshot_every`` batches
    these numbers are written whole to ``heads``, and the ledger has those of the batches after, which bounds
    what a batch has to read. A retried batch rewrites its own directories from what lies before it.

    A line delivered twice is dropped, however late it comes again. The ledger itself has the key of every line,
    so the stream keeps no other state: ``spans`` has the range of the first order column in each batch, and a
    batch is compared with the rows inside its own range, from the first to the last batch whose range meets it.
    Ends of tasks and the stdout fallback: :func:`stream_tasks`.
    """
    order = list(order)

    def number(batch: DataFrame, batch_id: int) -> None:
        spark, ledger = batch.sparkSession, f"{path}/ledger"
        fresh = stage(batch.select("otid", "appid", *order), "batch", "zstd")
        time = F.col(order[0])
        shares = fresh.groupBy(group_bound(["otid"])).agg(
            F.count("*").alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"), F.bool_or(time.isNull()).alias("open"))
        spans = KeyedStore(spark, f"{path}/spans", "of", compact_every=snapshot_every)
        own = shares.agg(
            F.lit(batch_id).alias("of"), F.max("n").alias("largest"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.bool_or("open").alias("open"))
        before = spans.open(batch_id)
        if spans.due(batch_id):
            # Made of what was there before, so a batch that runs again does not read the snapshot it writes.
            span = stage(own, "span")
            stamped = span.withColumn("_batch", F.lit(batch_id).cast("bigint"))
            spans.replace(stamped if before is None else before.unionByName(stamped), batch_id)
        else:
            span = spans.write(own, batch_id)
        largest = span.select("largest").first()[0] or 0
        known = _known_before(before, ledger, span, batch_id, order)
        if known is not None:
            fresh = join_keys(fresh, known, ["otid", *order], "left_anti")
            fresh = stage(fresh, "unknown", "zstd") if largest > group_limit else fresh
        rows = sequence_rows(fresh, ["otid"], order, group_limit=group_limit, largest=largest, once=True)
        store = KeyedStore(spark, f"{path}/heads", "otid", compact_every=snapshot_every)
        heads = _heads(store, ledger, batch_id, batch_id)
        if heads is not None:
            rows = rows.join(heads, "otid", "left").withColumn(
                "sequence", F.col("sequence") + F.coalesce("last", F.lit(0))).drop("last")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{ledger}/batch={batch_id}")
        if store.due(batch_id):
            store.replace(_heads(store, ledger, batch_id, batch_id + 1), batch_id)

    return (
        ids.writeStream.foreachBatch(number)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _known_before(spans: DataFrame | None, ledger: str, span: DataFrame, batch_id: int, order: list[str]) -> DataFrame | None:
    """Keys that earlier batches have in the range ``span`` of a batch; None if none of their ``spans`` meets it."""
    if spans is None:
        return None
    mine = span.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("open").alias("_open"))
    meets = (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo"))
    since, until = spans.join(mine, meets | (F.col("open") & F.col("_open"))).agg(F.min("of"), F.max("of")).first()
    if since is None:
        return None
    near = [f"{ledger}/batch={b}" for b in range(since, until + 1)]
    time = F.col(order[0])
    rows = span.sparkSession.read.parquet(*near).select("otid", *order)
    return rows.join(mine, time.between(F.col("_lo"), F.col("_hi")) | (time.isNull() & F.col("_open"))).select("otid", *order)


def _heads(store: KeyedStore, ledger: str, batch_id: int, until: int) -> DataFrame | None:
    """Last number of each task after all batches below ``until``, None if there are none.

    The store has no deltas: after its last snapshot before ``batch_id`` the ledger itself is read.
    """
    whole = store.sources(batch_id)
    since = int(whole[0].rpartition("/")[2]) if whole else -1
    parts = [store.spark.read.parquet(p).select("otid", "last") for p in whole]
    if after := [f"{ledger}/batch={b}" for b in range(since + 1, until)]:
        parts.append(store.spark.read.parquet(*after).select("otid", F.col("sequence").alias("last")))
    return reduce(DataFrame.unionAll, parts).groupBy("otid").agg(F.max("last").alias("last")) if parts else None


def close_intervals(submissions: DataFrame, start: str = "ts", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Intervals of the numbered submissions; ``end_ts`` is NULL while an application is open.

    The largest number tells how many rows the largest task has. Up to ``group_limit`` the rows are shuffled
    once, by task. Beyond it the next submission is found by an equi-join on task and number, which
    shuffles them twice but spreads even one huge task evenly.
    """
    if (submissions.agg(F.max("sequence")).first()[0] or 0) <= group_limit:
        return submissions.withColumn("end_ts", F.lead(start).over(W.partitionBy("otid").orderBy("sequence")))
    ends = submissions.select("otid", (F.col("sequence") - 1).alias("sequence"), F.col(start).alias("end_ts"))
    return join_keys(submissions, ends, ["otid", "sequence"], "left")


def stream_status(updates: DataFrame, path: str, checkpoint: str, key: str, cols: Sequence[str],
                  order: Sequence[str], compact_every: int = 10) -> StreamingQuery:
    """Keep the latest update of each key in a :class:`KeyedStore` under ``path``.

    Each micro-batch writes a small delta, and every ``compact_every`` batches they are merged into a
    snapshot. The base table is not touched; ``current_status`` merges on read.
    """
    cols, order = list(cols), list(order)

    def write_delta(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*cols, *order), F.struct(*order)).alias("_u"))
        KeyedStore(batch.sparkSession, path, key, order, compact_every).write(latest.select(key, "_u.*"), batch_id)

    return (
        updates.writeStream.foreachBatch(write_delta)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_status(table: DataFrame, path: str, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The base table with all updates applied; equal order values fall to the later batch."""
    latest = KeyedStore(table.sparkSession, path, key, order).read()
    return table if latest is None else apply_updates(table, latest, key, cols, order)
