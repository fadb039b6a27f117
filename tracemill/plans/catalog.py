"""Every named analysis as a function of a trace."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from tracemill.operators.aggregates import row_count, six_number_summary
from tracemill.plans import machines, placement, report, tasks, usage
from tracemill.plans.tasks import TASK
from tracemill.sources.schemas import FINISHED, SCHEDULED
from tracemill.sources.trace import Trace

Analysis = Callable[[Trace], DataFrame]

FINISHED_COUNT = "finished_task_count"


def _by_task(analysis: Analysis) -> Analysis:
    """An analysis that works on each task alone, over the parts of a trace."""
    return lambda t: reduce(DataFrame.unionByName, map(analysis, t.task_parts))


def _machine_analyses() -> dict[str, Analysis]:
    over_events = [
        machines.machines_latest_capacity, machines.distinct_machines,
        machines.machine_events_ordered, machines.machine_remove_events, machines.machine_removals_by_time,
        machines.machines_last_event, machines.machines_removed_for_good, machines.machine_update_configs,
        machines.machine_update_counts, machines.top_updated_machines, machines.machine_events_by_type,
        machines.machine_event_type_count, machines.machine_first_added, machines.add_configurations,
        machines.reconfigured_machines, machines.reconfigured_machine_events, machines.add_dist_cpu,
        machines.add_dist_memory, machines.add_dist_capacity, machines.add_dist_platform,
        machines.add_machine_total, report.mean_removal_gap,
    ]
    over_latest = [
        machines.machine_dist_cpu, machines.machine_dist_memory, machines.machine_dist_platform,
        machines.machine_dist_capacity, machines.machine_count,
    ]
    return {
        **{f.__name__: lambda t, f=f: f(t.machine_events) for f in over_events},
        "machines_latest": _latest,
        **{f.__name__: lambda t, f=f: f(_latest(t)) for f in over_latest},
        "removed_for_good_count": lambda t: report.removed_for_good_count(
            machines.machines_removed_for_good(t.machine_events)),
    }


def _latest(t: Trace) -> DataFrame:
    return t.shared("machines_latest", lambda: machines.machines_latest(t.machine_events))


def _task_analyses() -> dict[str, Analysis]:
    def life_cycle(t: Trace) -> DataFrame:
        return t.shared("life_cycle", lambda: tasks.task_life_cycle(t.tasks(*TASK, "event_type", "priority")))

    def per_job(t: Trace) -> DataFrame:
        return t.shared("tasks_per_job", lambda: tasks.tasks_per_job(t.tasks(*TASK)))

    def job_totals(t: Trace) -> DataFrame:
        return tasks.job_event_totals(t.job_events)

    def task_totals(t: Trace) -> DataFrame:
        return tasks.task_event_totals(t.tasks("event_type"))

    requests = ["cpu_request", "memory_request", "disk_space_request"]
    return {
        "row_count": lambda t: row_count(t.tasks(*TASK)),
        "tasks_per_job": per_job,
        "job_event_totals": job_totals,
        "task_event_totals": task_totals,
        "event_totals_table": lambda t: report.event_totals_table(job_totals(t), task_totals(t)),
        "task_life_cycle": life_cycle,
        "task_life_cycle_joined_ids": lambda t: tasks.task_life_cycle(
            t.tasks(*TASK, "event_type", "priority"), distinct="joined"),
        "task_life_cycle_events": lambda t: tasks.task_life_cycle_events(t.tasks("event_type", "priority")),
        "life_cycle_percent": lambda t: report.life_cycle_percent(life_cycle(t)),
        "job_task_totals": lambda t: report.job_task_totals(per_job(t)),
        "tasks_per_job_summary": lambda t: report.tasks_per_job_summary(per_job(t)),
        "distinct_jobs": lambda t: tasks.distinct_jobs(t.job_events),
        "daily_task_schedule": lambda t: tasks.daily_task_schedule(t.tasks("time", "event_type")),
        "task_schedule_events": lambda t: tasks.task_schedule_events(t.task_events),
        "task_schedule_pairs": lambda t: tasks.task_schedule_pairs(t.tasks("machine_id", "priority", "event_type")),
        "task_durations": _by_task(lambda t: tasks.task_durations(t.tasks("time", *TASK, "event_type", *requests))),
        "task_duration_anomalies": _by_task(lambda t: tasks.task_duration_anomalies(
            t.tasks("time", *TASK, "event_type", *requests))),
        "requested_resources": lambda t: tasks.requested_resources(t.tasks(*TASK, *requests[:2])),
        "task_attributes": _by_task(lambda t: tasks.task_attributes(
            t.tasks(*TASK, "event_type", "priority", *requests[:2]))),
        "task_attribute_rows": lambda t: tasks.task_attribute_rows(t.tasks(*tasks.ATTRIBUTES)),
        "task_attribute_row_count": lambda t: tasks.task_attribute_row_count(t.tasks(*tasks.ATTRIBUTES)),
    }


def _placement_analyses() -> dict[str, Analysis]:
    over_both = [
        placement.priority_machine_pairs, placement.priority_cpu_pairs,
        placement.priority_memory_pairs, placement.priority_capacity_pairs,
    ]

    def scheduled(t: Trace) -> DataFrame:
        return t.tasks("machine_id", "priority", "event_type")

    def relation(t: Trace) -> DataFrame:
        return t.shared("priority_capacity", lambda: placement.priority_capacity(scheduled(t), t.machine_events))

    def per_machine(t: Trace, event_type: int = SCHEDULED, name: str = "scheduled_task_count") -> DataFrame:
        return t.shared(name, lambda: placement.machine_task_counts(
            t.machine_events, t.tasks("machine_id", "event_type"), event_type, name))

    def finished(t: Trace) -> DataFrame:
        return per_machine(t, FINISHED, FINISHED_COUNT)

    return {
        **{f.__name__: lambda t, f=f: f(scheduled(t), t.machine_events) for f in over_both},
        "priority_capacity": relation,
        "tasks_by_priority": lambda t: report.tasks_by_priority(relation(t)),
        "priority_capacity_share": lambda t: report.priority_capacity_share(relation(t)),
        "task_counts_by_machine": lambda t: placement.task_counts_by_machine(
            t.tasks("machine_id", "event_type"), SCHEDULED),
        "machine_task_counts": per_machine,
        "machine_finished_counts": finished,
        "underused_machine_counts": lambda t: report.underused_machine_counts(per_machine(t)),
        "underused_machine_counts_finished": lambda t: report.underused_machine_counts(finished(t), FINISHED_COUNT),
        "tasks_per_machine_histogram": lambda t: report.tasks_per_machine_histogram(per_machine(t)),
        "tasks_per_machine_histogram_finished": lambda t: report.tasks_per_machine_histogram(
            finished(t), FINISHED_COUNT),
        "tasks_per_machine_summary": lambda t: report.tasks_per_machine_summary(per_machine(t)),
        "tasks_per_machine_summary_finished": lambda t: report.tasks_per_machine_summary(finished(t), FINISHED_COUNT),
        "broadcast_machine_lookup": lambda t: placement.machine_lookup(
            t.tasks("time", *TASK, "machine_id"), t.machine_events),
        "schedules_as_of": lambda t: placement.schedules_as_of(
            t.tasks("time", *TASK, "machine_id", "event_type", "priority"), t.machine_events),
        "task_attribute_lookup": _by_task(lambda t: placement.task_attribute_lookup(
            t.tasks("time", *tasks.ATTRIBUTES), t.task_usage, t.colocated)),
    }


def _usage_analyses() -> dict[str, Analysis]:
    def below_request(t: Trace, grain: str = "event") -> DataFrame:
        return _by_task(lambda p: usage.resource_requested_used(
            p.tasks(*TASK, "cpu_request", "memory_request"), p.task_usage, grain, p.colocated))(t)

    def histogram(t: Trace, grain: str = "event") -> DataFrame:
        return usage.percent_histogram(_by_task(lambda p: usage.weighted_below_request(
            p.tasks(*TASK, "cpu_request", "memory_request"), p.task_usage, grain))(t))

    def with_request(t: Trace) -> DataFrame:
        return usage.in_task_order(_by_task(lambda p: usage.usage_with_request(
            p.tasks(*TASK, "event_type", "priority", "cpu_request", "memory_request"), p.task_usage, ordered=False))(t))

    def against_capacity(t: Trace, **options) -> DataFrame:
        utilization = usage.machine_utilization(t.task_usage).withColumnRenamed("machine_utilization", "utilization")
        return usage.utilization_vs_capacity(utilization, _latest(t), **options)

    return {
        "max_resource_use": _by_task(lambda t: usage.max_resource_use(t.task_usage)),
        "task_usage_max": _by_task(lambda t: usage.task_usage_max(t.task_usage)),
        "machine_utilization": lambda t: usage.machine_utilization(t.task_usage),
        "machine_utilization_summary": lambda t: six_number_summary(
            usage.machine_utilization(t.task_usage), "machine_utilization"),
        "resource_requested_used": below_request,
        "resource_requested_used_per_task": lambda t: below_request(t, "task"),
        "consumption_histogram": histogram,
        "consumption_histogram_per_task": lambda t: histogram(t, "task"),
        "usage_with_request": with_request,
        "utilization_vs_capacity": against_capacity,
        "utilization_vs_capacity_full_days": lambda t: against_capacity(t, seconds=usage.FULL_DAYS),
        "unutilized_machine_count": lambda t: report.unutilized_machine_count(
            usage.machine_utilization(t.task_usage), _latest(t)),
    }


# They need the lines of machine_attributes, which a trace may lack.
ATTRIBUTE_ANALYSES: dict[str, Analysis] = {
    "attribute_lines": lambda t: t.machine_attributes,
    "attribute_line_count": lambda t: row_count(t.machine_attributes),
}

ANALYSES: dict[str, Analysis] = {
    **_machine_analyses(), **_task_analyses(), **_placement_analyses(), **_usage_analyses(), **ATTRIBUTE_ANALYSES,
}

# Results with a row per event, task, job or usage row; the others are small tables.
ROW_GRAIN = {
    "machine_events_ordered", "machine_remove_events", "machine_removals_by_time", "reconfigured_machine_events",
    "tasks_per_job", "task_schedule_events", "task_schedule_pairs", "task_durations", "task_duration_anomalies",
    "requested_resources", "task_attributes", "task_attribute_rows", "broadcast_machine_lookup",
    "task_attribute_lookup", "schedules_as_of", "max_resource_use", "task_usage_max", "resource_requested_used",
    "resource_requested_used_per_task", "usage_with_request", "attribute_lines",
}
