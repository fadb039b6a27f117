"""Sample traces in which a wrong analysis gives a wrong result, and their views in SQL.

The plain sample tables have no repeated job, no repeated attribute row, no unknown machine or task, no tie and
no idle machine. These rules, all on keys that both engines compute, put them in.
"""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tracemill.plans.catalog import ANALYSES
from tracemill.sources.trace import SampleTrace, Trace

NAMES = [
    "distinct_jobs", "task_attribute_rows", "task_attribute_row_count", "task_life_cycle", "task_life_cycle_joined_ids",
    "reconfigured_machines", "reconfigured_machine_events", "utilization_vs_capacity", "utilization_vs_capacity_full_days",
    "task_attribute_lookup", "priority_capacity", "unutilized_machine_count", "underused_machine_counts",
    "underused_machine_counts_finished", "consumption_histogram", "consumption_histogram_per_task", "machines_latest",
    "machine_dist_capacity", "schedules_as_of", "machine_utilization_summary",
]


class UnevenTrace(SampleTrace):
    """Every rule adds rows, or changes the rows of some keys."""

    @cached_property
    def machine_events(self) -> DataFrame:
        """Machines with one configuration; ties on machine and time."""
        time, machine = F.col("time"), F.col("machine_id")
        one = machine % 4 == 0
        events = super().machine_events.withColumns({
            "platform_id": F.when(one, F.lit("P0")).otherwise(F.col("platform_id")),
            "cpu": F.when(one, F.lit(0.5)).otherwise(F.col("cpu")),
            "memory": F.when(one, F.lit(0.5)).otherwise(F.col("memory")),
        })
        tied = events.where((time % 5 == 0) & (machine % 4 != 0)).withColumn("memory", F.lit(1.0) - F.col("memory") / 2)
        return events.unionByName(tied)

    @cached_property
    def job_events(self) -> DataFrame:
        """Jobs with several events."""
        jobs = super().job_events
        return jobs.unionByName(jobs.where(F.col("job_id") % 3 == 0).withColumn("time", F.col("time") + 1))

    def tasks(self, *columns: str) -> DataFrame:
        return self.task_events.select(*columns)

    @cached_property
    def task_events(self) -> DataFrame:
        """Repeated rows; tasks on machines that never were; tasks whose joined ids are those of others."""
        job, index = F.col("job_id"), F.col("task_index")
        tasks = super().task_events
        tasks = tasks.withColumn("machine_id", F.when(job % 13 == 0, F.col("machine_id") + 1_000_000).otherwise(F.col("machine_id")))
        # One scan and one join with the orders, whose rows are then made one to three.
        own = F.struct("job_id", "task_index")
        shifted = F.struct(F.floor(job / 10).alias("job_id"), ((job % 10) * 10 + index).alias("task_index"))
        ids = F.array(own, F.when(job % 5 == 0, own), F.when((job % 7 == 0) & (job >= 10), shifted))
        copies = tasks.withColumn("_ids", F.explode(F.filter(ids, lambda i: i.isNotNull())))
        return copies.withColumns({"job_id": F.col("_ids.job_id"), "task_index": F.col("_ids.task_index")}).drop("_ids")

    @cached_property
    def task_usage(self) -> DataFrame:
        """Idle machines; usage of unknown tasks and machines; use that rounds to all of the request."""
        job, machine = F.col("job_id"), F.col("machine_id")
        full = F.lit(1.0) - F.lit(1.0) / 16384
        request = super().task_usage.withColumn("_request", (F.col("end_time") - F.col("start_time")) / 6_000_000 / 64)
        return request.withColumns({
            "machine_id": F.when(job % 17 == 0, machine + 2_000_000).otherwise(machine),
            "assigned_memory_usage": F.when(machine % 9 == 0, F.lit(0.0)).otherwise(F.col("assigned_memory_usage")),
            "maximum_CPU_rate": F.when(job % 19 == 0, F.col("_request") * full).otherwise(F.col("maximum_CPU_rate")),
            "job_id": F.when(job % 11 == 0, job + 1_000_000_000).otherwise(job),
        }).drop("_request")


# SQL of the tables, over the plain views under the names base_<table>.
VIEWS = {
    "machine_one": """
        SELECT time, machine_id, event_type,
               CASE WHEN machine_id % 4 = 0 THEN 'P0' ELSE platform_id END AS platform_id,
               CASE WHEN machine_id % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE cpu END AS cpu,
               CASE WHEN machine_id % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE memory END AS memory FROM base_machine_events""",
    "machine_events": """
        SELECT * FROM machine_one UNION ALL
        SELECT time, machine_id, event_type, platform_id, cpu, 1 - memory / 2
        FROM machine_one WHERE time % 5 = 0 AND machine_id % 4 <> 0""",
    "job_events": """
        SELECT * FROM base_job_events UNION ALL
        SELECT * REPLACE (time + 1 AS time) FROM base_job_events WHERE job_id % 3 = 0""",
    "task_moved": """
        SELECT * REPLACE (CASE WHEN job_id % 13 = 0 THEN machine_id + 1000000 ELSE machine_id END AS machine_id)
        FROM base_task_events""",
    "task_events": """
        SELECT * FROM task_moved UNION ALL SELECT * FROM task_moved WHERE job_id % 5 = 0 UNION ALL
        SELECT * REPLACE (job_id // 10 AS job_id, (job_id % 10) * 10 + task_index AS task_index)
        FROM task_moved WHERE job_id % 7 = 0 AND job_id >= 10""",
    "task_usage": """
        SELECT * REPLACE (
          CASE WHEN job_id % 17 = 0 THEN machine_id + 2000000 ELSE machine_id END AS machine_id,
          CASE WHEN machine_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE assigned_memory_usage END AS assigned_memory_usage,
          CASE WHEN job_id % 19 = 0 THEN (end_time - start_time) / CAST(6000000 AS DOUBLE) / 64
            * (CAST(1 AS DOUBLE) - CAST(1 AS DOUBLE) / 16384) ELSE "maximum_CPU_rate" END AS "maximum_CPU_rate",
          CASE WHEN job_id % 11 = 0 THEN job_id + 1000000000 ELSE job_id END AS job_id) FROM base_task_usage""",
}

UNEVEN: dict[str, Callable[[Trace], DataFrame]] = {
    f"{name}_uneven": lambda t, name=name: ANALYSES[name](UnevenTrace(t.spark, t.folder)) for name in NAMES
}
