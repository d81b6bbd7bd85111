"""Job ledger: which applications a task spawned, in which order, and how the task ended."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import constants as C
from jobtrail.functions.parsing import engine_of, extract_app_ids, timestamp_to_stamp
from jobtrail.operators.keys import is_unfinished, task_by_instance
from jobtrail.operators.ordered import GROUP_LIMIT, largest_group, sequence_rows
from jobtrail.session import stage

ARRIVAL = ("ts", "tie1", "tie2", "tie3")


class Ledger:
    """Status of every task, and every application with its interval.

    Numbering measures the largest task first, so ``apps`` is planned only when it is asked for.
    """

    def __init__(self, tasks: DataFrame, plan_apps: Callable[[], DataFrame]):
        self.tasks, self._plan_apps = tasks, plan_apps

    @cached_property
    def apps(self) -> DataFrame:
        return self._plan_apps()


def number_apps(apps: DataFrame, order: Sequence[str], group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Sequence number of each application within its task, in arrival order."""
    return sequence_rows(apps, ["otid"], order, group_limit=group_limit)


def app_intervals(apps: DataFrame, order: Sequence[str], end: str, time: str | None = None,
                  group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Open interval of each application: it closes when the next one starts.

    The last application closes at the column ``end``. ``time`` is the start time, by default
    the first order column.
    """
    return sequence_rows(
        apps, ["otid"], order, following={"end_ts": time or order[0]}, group_limit=group_limit
    ).withColumn("end_ts", F.coalesce("end_ts", F.col(end)))


def final_status(optask: DataFrame, apptask: DataFrame, order: Sequence[str]) -> DataFrame:
    """Status of the last application of each task, FINISHED when there was none."""
    last = apptask.groupBy("otid").agg(
        F.max_by("status", F.struct(*order)).alias("status"), F.count("*").alias("n_apps")
    )
    return optask.select("otid").join(last, "otid", "left").select(
        "otid",
        F.coalesce("n_apps", F.lit(0)).alias("n_apps"),
        F.when(F.col("n_apps").isNull(), C.FINISHED).otherwise(F.col("status")).alias("status"),
    )


def app_ids_with_fallback(ids: DataFrame, optask: DataFrame) -> DataFrame:
    """Ids found on stderr; stdout counts only for sync tasks without any id on stderr."""
    err = ids.filter(F.col("stream") == "stderr")
    sync = optask.filter(F.col("submission") == "sync").select("otid")
    out = (
        ids.filter(F.col("stream") == "stdout")
        .join(sync, "otid", "left_semi")
        .join(err.select("otid").distinct(), "otid", "left_anti")
    )
    return err.unionByName(out)


def latest_app_status(app_events: DataFrame, order: Sequence[str]) -> DataFrame:
    """One status per application id: the latest report."""
    return app_events.groupBy("appid").agg(F.max_by("status", F.struct(*order)).alias("status"))


def build_ledger(tasks: DataFrame, lines: DataFrame, app_status: DataFrame,
                 order: Sequence[str] = ARRIVAL, time: str | None = None, strict: bool = False,
                 group_limit: int = GROUP_LIMIT) -> Ledger:
    """From log lines to the ledger.

    ``order`` is the arrival order within a task and must be unique there; ``time`` is the column
    intervals are made of, by default the first order column. The log text is read once: the few submission lines are staged, and every later step works
    on that small table. ``app_status`` has one row per appid.
    """
    time = time or order[0]
    needed = dict.fromkeys(["otid", "stream", "line", time, *order])
    found = stage(extract_app_ids(lines.select(*needed), strict), "app-ids")
    ids = app_ids_with_fallback(found, tasks)
    ends = found.groupBy("otid").agg(F.max(time).alias("_end"))
    known = app_status.select("appid", F.col("status").alias("_status"))

    def plan_apps() -> DataFrame:
        # ``ids`` is a subset of ``found``, whose largest task bounds the groups to number.
        numbered = sequence_rows(
            ids, ["otid"], order, following={"_next": time}, group_limit=group_limit,
            largest=largest_group(found, ["otid"]),
        )
        return (
            numbered.join(ends, "otid")
            .join(known, "appid", "left")
            .select("otid", "appid", "sequence", F.col(time).alias("start_ts"),
                    F.coalesce("_next", "_end").alias("end_ts"),
                    F.coalesce("_status", F.lit(C.RUNNING)).alias("status"))
        )

    # The task status needs only the last application, so aggregate first (map-side combine)
    # and join the statuses of those few.
    last = ids.groupBy("otid").agg(
        F.max_by("appid", F.struct(*order)).alias("appid"), F.count("*").alias("n_apps")
    )
    last = last.join(known, "appid", "left")  # before the tasks without application come in
    outcome = tasks.select("otid", "opid").join(last, "otid", "left").select(
        "otid", "opid",
        F.coalesce("n_apps", F.lit(0)).alias("n_apps"),
        F.col("appid").alias("last_appid"),
        F.when(F.col("appid").isNull(), C.FINISHED)
        .otherwise(F.coalesce("_status", F.lit(C.RUNNING))).alias("status"),
    )
    return Ledger(outcome, plan_apps)


def hive_status(state: Column) -> Column:
    """Task status of a Hive operation state; a task without an instance has failed."""
    return (
        F.when(state.isin(*C.HIVE_RUNNING_STATES), C.RUNNING)
        .when(state == C.HIVE_FINISHED_STATE, C.SUCCEEDED)
        .when(state == C.HIVE_CANCELED_STATE, C.KILLED)
        .otherwise(C.FAILED)
    )


def hive_task_status(optask: DataFrame, hiveinstance: DataFrame, order: str = "submittime") -> DataFrame:
    """Status of every Hive task from its last instance by ``order``."""
    hive = optask.filter(engine_of(F.col("opid")) == C.HIVE_ENGINE).select("otid")
    # Equal times are settled by the state, so that the result does not depend on the plan.
    states = hiveinstance.groupBy("otid").agg(F.max_by("state", F.struct(order, "state")).alias("state"))
    return hive.join(states, "otid", "left").select("otid", hive_status(F.col("state")).alias("status"))


def task_outcomes(optask: DataFrame, outcome: DataFrame, hiveinstance: DataFrame) -> DataFrame:
    """Final status by engine: Hive tasks from their instance, all others from ``outcome``."""
    hive = F.coalesce(engine_of(F.col("opid")) == C.HIVE_ENGINE, F.lit(False))
    yarn = optask.filter(~hive).select("otid").join(outcome.select("otid", "status"), "otid")
    return yarn.withColumn("tracker", F.lit("yarn")).unionByName(
        hive_task_status(optask, hiveinstance).withColumn("tracker", F.lit("hive"))
    )


def resolve_result(tasks: DataFrame, out: DataFrame, err: DataFrame) -> DataFrame:
    """Result document of each task: stdout, else stderr, else an error naming both paths."""
    base = F.when(F.col("base_path").endswith("/"), F.col("base_path")).otherwise(
        F.concat("base_path", F.lit("/"))
    )
    missing = F.concat(base, F.lit("stdout.xml and "), base, F.lit("stderr.xml not exist"))
    return (
        tasks.select("otid", "base_path")
        .join(out.select("otid", "stdout"), "otid", "left")
        .join(err.select("otid", "stderr"), "otid", "left")
        .select(
            "otid",
            F.when(F.col("stdout").isNotNull(), "stdout").when(F.col("stderr").isNotNull(), "stderr")
            .otherwise("error").alias("source"),
            F.coalesce("stdout", "stderr", missing).alias("result"),
        )
    )


def apply_kill(results: DataFrame, optask: DataFrame) -> DataFrame:
    """A killed task answers with an error, whatever it wrote."""
    killed = optask.filter(F.col("status") == C.KILLED).select("otid", F.lit(True).alias("_killed"))
    return results.join(killed, "otid", "left").select(
        "otid",
        F.when(F.col("_killed"), "error").otherwise(F.col("source")).alias("source"),
        F.when(F.col("_killed"), C.TASK_KILLED).otherwise(F.col("result")).alias("result"),
    )


def kill_plan(ids: DataFrame, optask: DataFrame, apptask: DataFrame, strict: bool = False) -> DataFrame:
    """What stopping each requested task takes, one row per step.

    A running task lists every unfinished application; with none left it needs only its own
    status changed (``appid`` NULL). ``message`` says why nothing is to be done.
    """
    known = optask.select("otid", "opid", "status")
    asked = ids.select("otid").distinct().join(known, "otid", "left").select(
        "otid",
        F.when(F.col("opid").isNull(), C.NOT_EXIST)
        .when(F.coalesce(F.col("status"), F.lit("")) != C.RUNNING, C.ALREADY_FINISHED)
        .when(engine_of(F.col("opid")) == C.HIVE_ENGINE, C.HIVE_CANCEL)
        .otherwise(C.KILL_APPLICATION).alias("action"),
    )
    live = apptask.filter(is_unfinished(F.col("status"), strict)).select("otid", "sequence", "appid")
    kills = asked.filter(F.col("action") == C.KILL_APPLICATION).join(live, "otid", "left")
    rest = asked.filter(F.col("action") != C.KILL_APPLICATION).withColumns({
        "sequence": F.lit(None).cast(live.schema["sequence"].dataType),
        "appid": F.lit(None).cast("string"),
    })
    message = (
        F.when(F.col("action") == C.NOT_EXIST, F.format_string(C.TASK_UNKNOWN, F.col("otid")))
        .when(F.col("action") == C.ALREADY_FINISHED, F.format_string(C.TASK_FINISHED, F.col("otid")))
        .otherwise("")
    )
    return kills.unionByName(rest).withColumn("message", message)


def kill_by_instance(keys: DataFrame, optask: DataFrame, apptask: DataFrame, strict: bool = False) -> DataFrame:
    """Kill plan of the latest task of each (jobinstanceid, opid); ``otid`` is NULL where there is none."""
    found = task_by_instance(optask, keys)
    known = found.filter(F.col("otid") != C.NOT_EXIST)
    steps = known.join(kill_plan(known, optask, apptask, strict), "otid")
    unknown = found.filter(F.col("otid") == C.NOT_EXIST).select(
        F.lit(None).cast("string").alias("otid"), "jobinstanceid", "opid", F.lit(C.NOT_EXIST).alias("action"),
        F.format_string(C.INSTANCE_NOT_SUBMITTED, "opid", "jobinstanceid").alias("message"))
    return steps.unionByName(unknown, allowMissingColumns=True)


def kill_outcome(apps: DataFrame) -> DataFrame:
    """Did every kill of a task succeed, and which application failed first."""
    failed = ~F.col("killed")
    return apps.groupBy("otid").agg(
        F.bool_and("killed").alias("all_killed"),
        F.min_by(F.when(failed, F.col("appid")), F.when(failed, F.col("sequence"))).alias("first_failure"),
    ).withColumns({
        "status": F.when(F.col("all_killed"), C.KILLED).otherwise(C.RUNNING),
        "message": F.when(F.col("all_killed"), "").otherwise(
            F.format_string(C.KILL_REFUSED, F.col("first_failure"))),
    })


def start_tasks(requests: DataFrame) -> DataFrame:
    """New ledger rows for accepted requests: id from operator and stamp, RUNNING, default queue."""
    stamp = timestamp_to_stamp(F.col("submit_ts"))
    return requests.select(
        F.concat("opid", stamp).alias("otid"),
        "opid", "processid", "jobinstanceid", "username",
        F.coalesce("queuename", F.lit(C.DEFAULT_QUEUE)).alias("queuename"),
        stamp.alias("submittime"), "submission",
        F.lit(C.RUNNING).alias("status"),
    )


def log_requests(keys: DataFrame, optask: DataFrame, apptask: DataFrame) -> DataFrame:
    """Answer to each log request before any log is read: its applications, or why there is none."""
    counts = apptask.groupBy("otid").agg(F.count("*").alias("n_apps"))
    asked = task_by_instance(optask, keys).join(counts, "otid", "left")
    unknown = F.format_string(C.INSTANCE_UNKNOWN, F.col("opid"), F.col("jobinstanceid"))
    return asked.select(
        "jobinstanceid", "opid", "otid", F.coalesce("n_apps", F.lit(0)).alias("n_apps"),
        F.when(F.col("otid") == C.NOT_EXIST, unknown)
        .when(F.col("n_apps").isNull(), C.NO_APPLICATION_ID).otherwise("").alias("message"),
    )


def task_logs(keys: DataFrame, optask: DataFrame, apptask: DataFrame, sections: DataFrame) -> DataFrame:
    """Container log rows of all applications of the requested (jobinstanceid, opid) pairs.

    Log rows come out of Python, where Spark takes the few ranges that go in for their size and would broadcast
    all text; so the join is told to hash the applications and let the rows stream by.
    """
    tasks = task_by_instance(optask, keys)
    apps = tasks.join(apptask.select("otid", "sequence", "appid"), "otid")
    return apps.hint("shuffle_hash").join(sections, "appid")
