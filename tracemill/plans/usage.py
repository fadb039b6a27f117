"""Resource usage: maxima per task, requested against used, machine utilization.

``usage`` is the task_usage table, ``tasks`` the task_events table.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.columns import SECOND, percent
from tracemill.operators.histogram import bucket_histogram
from tracemill.operators.joins import lookup_join
from tracemill.operators.order import stored_order
from tracemill.plans.tasks import TASK, requested_resources, task_attributes

PERCENT_EDGES = list(range(0, 101, 5))
# Fixed value: the factor of the published capacity column. Its name says 29 days; those have FULL_DAYS seconds.
PUBLISHED_SECONDS = 29 * 60 * 60
FULL_DAYS = 29 * 24 * 60 * 60


def max_resource_use(usage: DataFrame) -> DataFrame:
    return usage.groupBy(*TASK).agg(
        F.max("maximum_CPU_rate").alias("maximum_CPU_usage"),
        F.max("maximum_memory_usage").alias("maximum_memory_usage"),
    )


def task_usage_max(usage: DataFrame) -> DataFrame:
    names = ["maximum_memory_usage", "maximum_CPU_rate", "assigned_memory_usage"]
    return usage.groupBy(*TASK).agg(*[F.max(c).alias(c) for c in names])


def machine_utilization(usage: DataFrame) -> DataFrame:
    """Sum over a machine's usage rows of seconds times assigned memory times sampled cpu."""
    seconds = (F.col("end_time") - F.col("start_time")) / SECOND
    used = seconds * F.col("assigned_memory_usage") * F.col("sampled_CPU_usage")
    return usage.groupBy("machine_id").agg(F.sum(used).alias("machine_utilization"))


def _check_grain(grain: str) -> None:
    if grain not in ("event", "task"):
        raise ValueError(f"unknown grain {grain!r}")


def _largest_requests(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*TASK).agg(*[F.max(c).alias(c) for c in ("cpu_request", "memory_request")])


def _below_request(joined: DataFrame, *more: str) -> DataFrame:
    """Rows whose use stays below both requests, with the used percentages."""
    below = joined.where(
        (F.col("cpu_request") > F.col("maximum_CPU_usage"))
        & (F.col("memory_request") > F.col("maximum_memory_usage"))
    )
    return below.select(
        *TASK, "cpu_request", "memory_request", "maximum_CPU_usage", "maximum_memory_usage",
        percent(F.col("maximum_CPU_usage"), F.col("cpu_request"), 1).alias("used_cpu_percent"),
        percent(F.col("maximum_memory_usage"), F.col("memory_request"), 1).alias("used_memory_percent"),
        *more,
    )


def resource_requested_used(tasks: DataFrame, usage: DataFrame, grain: str = "event", colocated: bool = False) -> DataFrame:
    """Tasks whose largest cpu and memory use both stay below the request, with the used percentages.

    ``grain`` "event" compares every task event's request, so a task comes once per event, which
    matches published counts; "task" compares the largest request of each task once. ``colocated``
    says that both tables are bucketed by task and no task is hot.
    """
    _check_grain(grain)
    used, requests = max_resource_use(usage), requested_resources(tasks)
    if grain == "event":
        return _below_request(requests.join(used, TASK) if colocated else lookup_join(requests, used, TASK))
    return _below_request(_largest_requests(requests).join(used, TASK))


def weighted_below_request(tasks: DataFrame, usage: DataFrame, grain: str = "event") -> DataFrame:
    """Rows of :func:`resource_requested_used`, equal requests of a task as one row, with their number in ``_rows``.

    They are counted before they meet the task's use, so a task with very many events is a few rows in the join.
    """
    _check_grain(grain)
    requests = requested_resources(tasks)
    if grain == "event":
        requests = requests.groupBy(*TASK, "cpu_request", "memory_request").agg(F.count("*").alias("_rows"))
    else:
        requests = _largest_requests(requests).withColumn("_rows", F.lit(1))
    return _below_request(requests.join(max_resource_use(usage), TASK), "_rows")


def percent_histogram(below: DataFrame, edges: Sequence[float] = PERCENT_EDGES) -> DataFrame:
    """Rows of :func:`weighted_below_request` per bucket of used cpu and memory percent."""
    measures = {"cpu_count": "used_cpu_percent", "memory_count": "used_memory_percent"}
    return bucket_histogram(below, measures, edges, "_rows")


def consumption_histogram(
    tasks: DataFrame, usage: DataFrame, grain: str = "event", edges: Sequence[float] = PERCENT_EDGES
) -> DataFrame:
    """Rows of :func:`resource_requested_used` per bucket of used cpu and memory percent."""
    return percent_histogram(weighted_below_request(tasks, usage, grain), edges)


def usage_with_request(tasks: DataFrame, usage: DataFrame, ordered: bool = True) -> DataFrame:
    """Usage maxima beside the attributes of each scheduled task, in task order.

    For the order the result is written once and sorted from there (see :func:`stored_order`).
    """
    joined = task_usage_max(usage).join(task_attributes(tasks), TASK)
    return in_task_order(joined) if ordered else joined


def in_task_order(joined: DataFrame) -> DataFrame:
    return stored_order(joined, TASK, "usage_with_request")


def utilization_vs_capacity(
    utilization: DataFrame, latest: DataFrame, seconds: int = PUBLISHED_SECONDS
) -> DataFrame:
    """Utilization (columns machine_id, utilization) beside what the machine could have offered."""
    joined = utilization.join(latest.select("machine_id", "cpu", "memory"), "machine_id", "left")
    available = F.lit(seconds) * F.col("cpu") * F.col("memory")
    return joined.select(
        "machine_id", "cpu", "memory", "utilization", available.alias("available_capacity_for_29_days")
    ).orderBy("utilization", "machine_id")
