"""Jobs and tasks: counts, life cycles, daily schedules, durations, attributes.

``tasks`` is the task_events table, ``jobs`` the job_events table. A task is (job_id, task_index).
"""

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.columns import elapsed_seconds, joined_ids, whole_days
from tracemill.operators.aggregates import count_by_code, count_distinct, distinct_then_count
from tracemill.sources import schemas as codes

TASK = ["job_id", "task_index"]
ATTRIBUTES = ["job_id", "task_index", "machine_id", "priority", "cpu_request", "memory_request"]
# Result columns of the life cycle, each with its event code.
LIFE_CYCLE = {
    "evicted_task_count": codes.EVICTED,
    "failed_task_count": codes.FAILED,
    "killed_task_count": codes.KILLED,
    "lost_task_count": codes.LOST,
    "submitted_task_count": codes.SUBMITTED,
    "scheduled_task_count": codes.SCHEDULED,
    "finished_task_count": codes.FINISHED,
    "update_pending_task_count": codes.UPDATE_PENDING,
    "update_running_task_count": codes.UPDATE_RUNNING,
}


def tasks_per_job(tasks: DataFrame) -> DataFrame:
    return distinct_then_count(tasks, "job_id", "task_index", "task_count")


def _totals(events: DataFrame, noun: str) -> DataFrame:
    names = {"scheduled": codes.SCHEDULED, "evicted": codes.EVICTED, "killed": codes.KILLED}
    return count_by_code(events, "event_type", {f"{k}_{noun}_count": v for k, v in names.items()})


def job_event_totals(jobs: DataFrame) -> DataFrame:
    return _totals(jobs, "job")


def task_event_totals(tasks: DataFrame) -> DataFrame:
    return _totals(tasks, "task")


def task_life_cycle(tasks: DataFrame, distinct: str = "exact") -> DataFrame:
    """Events of each type and number of tasks per priority.

    ``distinct``: "exact" counts (job_id, task_index) pairs; "joined" counts the two ids written as
    one text, as published counts do, where (1, 23) and (12, 3) are one task; "estimated" takes an
    approximate count within 1 %, which needs no shuffle of the pairs.
    """
    number = {
        "exact": F.count_distinct(*TASK),
        "joined": F.count_distinct(joined_ids(*TASK)),
        "estimated": F.approx_count_distinct(F.struct(*TASK), 0.01),
    }[distinct]
    by = count_by_code(tasks, "event_type", LIFE_CYCLE, ["priority"], number.alias("distinct_task_count"))
    return by.orderBy(F.desc("priority"))


def task_life_cycle_events(tasks: DataFrame) -> DataFrame:
    return count_by_code(tasks, "event_type", LIFE_CYCLE, ["priority"]).orderBy(F.desc("priority"))


def distinct_jobs(jobs: DataFrame, error: float | None = None) -> DataFrame:
    return count_distinct(jobs, ["job_id"], "job_count", error)


def task_schedule_events(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("event_type") == codes.SCHEDULED)


def task_schedule_pairs(tasks: DataFrame) -> DataFrame:
    return task_schedule_events(tasks).select("machine_id", "priority")


def daily_task_schedule(tasks: DataFrame) -> DataFrame:
    by = task_schedule_events(tasks).groupBy(whole_days().alias("day"))
    return by.agg(F.count("*").alias("task_schedule_count")).orderBy(F.desc("day"))


def task_durations(tasks: DataFrame) -> DataFrame:
    """From the last schedule to the last finish of each task that has both, in one pass.

    The requests are those of the last finish event.
    """
    time, kind = F.col("time"), F.col("event_type")
    requests = ["cpu_request", "memory_request", "disk_space_request"]
    ends = (
        tasks.where(kind.isin(codes.SCHEDULED, codes.FINISHED))
        .groupBy(*TASK)
        .agg(
            F.max(F.when(kind == codes.SCHEDULED, time)).alias("start_time"),
            F.max(F.when(kind == codes.FINISHED, F.struct("time", *requests))).alias("_finish"),
        )
        .where(F.col("start_time").isNotNull() & F.col("_finish").isNotNull())
    )
    return ends.select(
        *TASK,
        *[F.col("_finish")[c].alias(c) for c in requests],
        "start_time",
        F.col("_finish")["time"].alias("end_time"),
        elapsed_seconds(F.col("start_time"), F.col("_finish")["time"]).alias("elapsed_time"),
    )


def task_duration_anomalies(tasks: DataFrame) -> DataFrame:
    """Tasks whose last finish lies before their last schedule."""
    return task_durations(tasks).where(F.col("end_time") - F.col("start_time") < 0)


def requested_resources(tasks: DataFrame) -> DataFrame:
    return tasks.select(*TASK, "cpu_request", "memory_request")


def task_attributes(tasks: DataFrame) -> DataFrame:
    """Largest priority and requests among the schedule events of each task."""
    names = ["priority", "cpu_request", "memory_request"]
    return task_schedule_events(tasks).groupBy(*TASK).agg(*[F.max(c).alias(c) for c in names])


def task_attribute_rows(tasks: DataFrame) -> DataFrame:
    return tasks.select(*ATTRIBUTES).distinct()


def task_attribute_row_count(tasks: DataFrame) -> DataFrame:
    return task_attribute_rows(tasks).agg(F.count("*").alias("row_count"))
