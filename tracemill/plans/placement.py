"""Where tasks ran: priority against machine capacity, tasks per machine, attribute lookups.

Joins with machines come after the events are counted per machine, so the event rows are never
shuffled by machine and a busy machine is no hot key.
"""

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.columns import DAY
from tracemill.operators.aggregates import distribution, latest_by
from tracemill.operators.asof import as_of_join
from tracemill.operators.joins import BROADCAST_BYTES, lookup_join
from tracemill.plans.machines import machines_latest_capacity
from tracemill.plans.tasks import TASK, task_schedule_pairs
from tracemill.sources.schemas import ADDED, SCHEDULED


def priority_capacity(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Scheduled events per priority and machine capacity, with the smallest (cpu, memory) of that capacity."""
    counted = distribution(task_schedule_pairs(tasks), ["machine_id", "priority"], "_n")
    by = (
        counted.join(machines_latest_capacity(events), "machine_id")
        .groupBy("priority", "capacity")
        .agg(F.min(F.struct("cpu", "memory")).alias("_kind"), F.sum("_n").alias("task_count"))
    )
    return by.select("priority", F.col("_kind.cpu"), F.col("_kind.memory"), "capacity", "task_count")


def priority_machine_pairs(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Each machine once per priority that was scheduled on it."""
    pairs = task_schedule_pairs(tasks).distinct()
    joined = pairs.join(machines_latest_capacity(events), "machine_id")
    return joined.select("priority", "machine_id", "cpu", "memory", "capacity")


def priority_cpu_pairs(tasks: DataFrame, events: DataFrame) -> DataFrame:
    return distribution(priority_machine_pairs(tasks, events), ["priority", "cpu"]).orderBy("priority", "cpu")


def priority_memory_pairs(tasks: DataFrame, events: DataFrame) -> DataFrame:
    return distribution(priority_machine_pairs(tasks, events), ["priority", "memory"]).orderBy("priority", "memory")


def priority_capacity_pairs(tasks: DataFrame, events: DataFrame) -> DataFrame:
    return distribution(priority_machine_pairs(tasks, events), ["priority", "capacity"]).orderBy("priority", "capacity")


def task_counts_by_machine(tasks: DataFrame, event_type: int, name: str = "scheduled_task_count") -> DataFrame:
    return distribution(tasks.where(F.col("event_type") == event_type), ["machine_id"], name)


def machine_task_counts(
    events: DataFrame, tasks: DataFrame, event_type: int = SCHEDULED, name: str = "scheduled_task_count"
) -> DataFrame:
    """Every machine with its number of task events of one type, null where it has none."""
    machines = events.select("machine_id").distinct()
    joined = machines.join(task_counts_by_machine(tasks, event_type, name), "machine_id", "left")
    return joined.orderBy(F.asc_nulls_first(name), "machine_id")


def machine_lookup(tasks: DataFrame, events: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every task event with the latest cpu and memory of its machine, null where that is unknown.

    The machine table is counted; while it is small the task events stay where they are.
    """
    machines = machines_latest_capacity(events).select("machine_id", "cpu", "memory")
    keys = tasks.select("time", *TASK, "machine_id")
    joined = lookup_join(keys, machines, ["machine_id"], "left", broadcast_bytes)
    return joined.select("time", *TASK, "machine_id", "cpu", "memory")


def task_attribute_lookup(tasks: DataFrame, usage: DataFrame, colocated: bool = False) -> DataFrame:
    """Every usage row with the attributes in the last event of its task, null where the task is unknown.

    ``colocated`` says that both tables are bucketed by task and no task is hot.
    """
    names = ["machine_id", "priority", "cpu_request", "memory_request"]
    latest = latest_by(tasks, TASK, ["time"], names)
    rows = usage.select("start_time", *TASK)
    joined = rows.join(latest, TASK, "left") if colocated else lookup_join(rows, latest, TASK, "left")
    return joined.select("start_time", *TASK, *names)


def schedules_as_of(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Every schedule event with the capacity that its machine was last added with, null where it was not added by then."""
    added = events.where(F.col("event_type") == ADDED).select("machine_id", "time", "platform_id", "cpu", "memory")
    scheduled = tasks.where(F.col("event_type") == SCHEDULED).select("time", *TASK, "machine_id", "priority")
    return as_of_join(scheduled, added, "machine_id", "time", ["platform_id", "cpu", "memory"], DAY)
