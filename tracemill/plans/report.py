"""Statistics over the results of the other plans."""

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.columns import percent
from tracemill.operators.aggregates import mean_gap, share_within, six_number_summary
from tracemill.operators.histogram import centred_histogram
from tracemill.sources.schemas import REMOVED


def job_task_totals(tasks_per_job: DataFrame) -> DataFrame:
    return tasks_per_job.agg(
        F.count("*").alias("number_of_jobs"),
        F.coalesce(F.sum("task_count"), F.lit(0).cast("bigint")).alias("number_of_tasks"),
        F.avg("task_count").alias("avg_task_count"),
    )


def tasks_per_job_summary(tasks_per_job: DataFrame, error: float | None = None) -> DataFrame:
    return six_number_summary(tasks_per_job, "task_count", error)


def event_totals_table(job_totals: DataFrame, task_totals: DataFrame) -> DataFrame:
    """The two rows of totals below each other."""
    def row(totals: DataFrame, noun: str) -> DataFrame:
        kinds = ("scheduled", "evicted", "killed")
        return totals.select(
            F.lit(noun.capitalize()).alias("type"), *[F.col(f"{k}_{noun}_count").alias(f"{k}_count") for k in kinds]
        )

    return row(job_totals, "job").unionByName(row(task_totals, "task"))


def life_cycle_percent(life_cycle: DataFrame) -> DataFrame:
    """Events per hundred tasks of each priority."""
    number = F.col("distinct_task_count")
    return life_cycle.select(
        "priority",
        *[percent(F.col(f"{k}_task_count"), number, 1).alias(f"{k}_percent")
          for k in ("killed", "evicted", "failed", "lost")],
        number.alias("task_count"),
    ).orderBy(F.desc("priority"))


def tasks_by_priority(priority_capacity: DataFrame) -> DataFrame:
    by = priority_capacity.groupBy("priority").agg(F.sum("task_count").alias("total_task_count"))
    return by.orderBy("priority")


def priority_capacity_share(priority_capacity: DataFrame) -> DataFrame:
    """Cells of the heat map: the part of a priority's tasks that ran on each capacity, in percent."""
    cells = priority_capacity.select("priority", "capacity", "task_count")
    shares = share_within(cells, "priority", "task_count", "total_task_count", "task_percentage", 1)
    return shares.orderBy("priority", "capacity")


def mean_removal_gap(machine_events: DataFrame) -> DataFrame:
    return mean_gap(machine_events.where(F.col("event_type") == REMOVED), "time", "mean_gap_seconds")


def removed_for_good_count(removed_for_good: DataFrame) -> DataFrame:
    return removed_for_good.agg(F.count("*").alias("machine_count"))


def underused_machine_counts(task_counts: DataFrame, column: str = "scheduled_task_count") -> DataFrame:
    """Machines with no, fewer than 10 and fewer than 100 task events; those with none count in all three."""
    n = F.coalesce(F.col(column), F.lit(0))
    return task_counts.agg(
        F.count_if(n == 0).alias("zero_count"),
        F.count_if(n < 10).alias("below_10_count"),
        F.count_if(n < 100).alias("below_100_count"),
    )


def unutilized_machine_count(utilization: DataFrame, latest: DataFrame) -> DataFrame:
    """Machines whose utilization is 0, and known machines without any usage row."""
    known = latest.select("machine_id", F.lit(True).alias("_known"))
    return utilization.join(known, "machine_id", "full").agg(
        F.count_if(F.col("machine_utilization") == 0).alias("zero_utilization_count"),
        F.count_if(F.col("_known") & F.col("machine_utilization").isNull()).alias("absent_count"),
    )


def tasks_per_machine_histogram(
    task_counts: DataFrame, column: str = "scheduled_task_count", width: int = 50
) -> DataFrame:
    return centred_histogram(task_counts, column, width, "machine_count")


def tasks_per_machine_summary(
    task_counts: DataFrame, column: str = "scheduled_task_count", error: float | None = None
) -> DataFrame:
    return six_number_summary(task_counts, column, error)
