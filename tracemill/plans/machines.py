"""Machines: latest state, capacity distributions, availability, updates, reconfigurations.

``events`` is the machine_events table, ``latest`` the result of :func:`machines_latest`.
"""

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.columns import capacity
from tracemill.operators.aggregates import count_distinct, distribution, latest_by
from tracemill.operators.joins import lookup_join
from tracemill.sources.schemas import ADDED, MACHINE_EVENTS, REMOVED, UPDATED

# The largest of these wins where a machine has several events at its last time.
EVENT_ORDER = ["time", "event_type", "platform_id", "cpu", "memory"]
CONFIGURATION = ["machine_id", "platform_id", "cpu", "memory"]


def machines_latest(events: DataFrame) -> DataFrame:
    return latest_by(events, ["machine_id"], EVENT_ORDER, EVENT_ORDER).select(*MACHINE_EVENTS.columns)


def machines_latest_capacity(events: DataFrame) -> DataFrame:
    return machines_latest(events).select("machine_id", "cpu", "memory", capacity().alias("capacity"))


def machine_dist_cpu(latest: DataFrame) -> DataFrame:
    by = distribution(latest.withColumnRenamed("cpu", "cpu_capacity"), ["cpu_capacity"], "number_of_machines")
    return by.orderBy(F.desc("cpu_capacity"))


def machine_dist_memory(latest: DataFrame) -> DataFrame:
    by = distribution(latest.withColumnRenamed("memory", "memory_capacity"), ["memory_capacity"], "number_of_machines")
    return by.orderBy(F.desc("memory_capacity"))


def machine_dist_platform(latest: DataFrame) -> DataFrame:
    return distribution(latest, ["platform_id"], "number_of_machines").orderBy(F.desc("platform_id"))


def machine_dist_capacity(latest: DataFrame) -> DataFrame:
    by = distribution(latest, ["cpu", "memory"], "number_of_machines", "machine_percentage")
    return by.select(
        "cpu", "memory", capacity().alias("capacity"), "number_of_machines", "machine_percentage"
    ).orderBy(F.desc("capacity"), F.desc("cpu"))


def machine_count(latest: DataFrame) -> DataFrame:
    return latest.agg(F.count("*").alias("machine_count"))


def distinct_machines(events: DataFrame) -> DataFrame:
    return count_distinct(events, ["machine_id"], "machine_count")


def machine_events_ordered(events: DataFrame) -> DataFrame:
    """By time; the other columns after it let the sort spread many events of one time."""
    return events.orderBy("time", "machine_id", "event_type", "platform_id", "cpu", "memory")


def machine_remove_events(events: DataFrame) -> DataFrame:
    return machine_events_ordered(events.where(F.col("event_type") == REMOVED))


def machine_removals_by_time(events: DataFrame) -> DataFrame:
    removals = events.where(F.col("event_type") == REMOVED)
    return removals.select("time", "machine_id", "platform_id", "cpu", "memory").orderBy(
        "time", "platform_id", "machine_id", "cpu", "memory"
    )


def machines_last_event(events: DataFrame) -> DataFrame:
    last = latest_by(events, ["machine_id"], ["time", "event_type"], ["event_type", "time"])
    return last.withColumnsRenamed({"event_type": "last_event", "time": "last_event_time"})


def machines_removed_for_good(events: DataFrame) -> DataFrame:
    return machines_last_event(events).where(F.col("last_event") == REMOVED)


def machine_history(events: DataFrame, machine_id: int) -> DataFrame:
    mine = events.where(F.col("machine_id") == F.lit(machine_id).cast("bigint"))
    return mine.select(*MACHINE_EVENTS.columns).orderBy("time", "event_type", "platform_id", "cpu", "memory")


def machine_update_configs(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == UPDATED).select(*CONFIGURATION).distinct()


def machine_update_counts(events: DataFrame) -> DataFrame:
    by = distribution(machine_update_configs(events), ["machine_id"], "update_count")
    return by.orderBy(F.desc("update_count"), "machine_id")


def top_updated_machines(events: DataFrame, n: int = 10) -> DataFrame:
    return machine_update_counts(events).limit(n)


def machine_events_by_type(events: DataFrame) -> DataFrame:
    return distribution(events, ["event_type"])


def machine_event_type_count(events: DataFrame) -> DataFrame:
    return machine_events_by_type(events).agg(F.count("*").alias("event_type_count"))


def machine_first_added(events: DataFrame) -> DataFrame:
    added = events.where(F.col("event_type") == ADDED)
    return added.groupBy("machine_id").agg(F.min("time").alias("first_time"))


def add_configurations(events: DataFrame) -> DataFrame:
    added = events.where(F.col("event_type") == ADDED).select(*CONFIGURATION).distinct()
    return added.withColumn("capacity", capacity())


def reconfigured_machines(events: DataFrame) -> DataFrame:
    """Machines that were added in more than one configuration."""
    return distribution(add_configurations(events), ["machine_id"]).where(F.col("count") > 1)


def reconfigured_machine_events(events: DataFrame) -> DataFrame:
    joined = lookup_join(events, reconfigured_machines(events), ["machine_id"])
    return joined.select(*MACHINE_EVENTS.columns, "count").orderBy(
        "machine_id", "time", "event_type", "platform_id", "cpu", "memory"
    )


def add_dist_cpu(events: DataFrame) -> DataFrame:
    return distribution(add_configurations(events), ["cpu"]).orderBy(F.desc("cpu"))


def add_dist_memory(events: DataFrame) -> DataFrame:
    return distribution(add_configurations(events), ["memory"]).orderBy(F.desc("memory"))


def add_dist_capacity(events: DataFrame) -> DataFrame:
    return distribution(add_configurations(events), ["capacity"]).orderBy(F.desc("capacity"))


def add_dist_platform(events: DataFrame) -> DataFrame:
    return distribution(add_configurations(events), ["platform_id"]).orderBy(F.desc("platform_id"))


def add_machine_total(events: DataFrame) -> DataFrame:
    by = distribution(add_configurations(events), ["capacity"])
    return by.agg(F.coalesce(F.sum("count"), F.lit(0).cast("bigint")).alias("machine_count"))
