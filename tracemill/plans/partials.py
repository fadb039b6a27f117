"""Stored states per day and priority, from which totals of any range of days are merged.

A state has the counts of events and a sketch of the distinct tasks. Counts add up exactly, sketches
unite to an estimate; event rows of days that are stored are not read again.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.functions.columns import whole_days
from tracemill.operators.aggregates import count_by_code
from tracemill.plans.tasks import LIFE_CYCLE, TASK

#: Relative error of a sketch of 2^14 registers: about 0.8 %.
LOG_REGISTERS = 14


def daily_states(tasks: DataFrame) -> DataFrame:
    """Per day and priority: events of each type, and a sketch of the (job_id, task_index) pairs."""
    sketch = F.hll_sketch_agg(F.concat_ws("/", *TASK), F.lit(LOG_REGISTERS)).alias("tasks")
    return count_by_code(tasks.withColumn("day", whole_days()), "event_type", LIFE_CYCLE, ["day", "priority"], sketch)


def store_days(tasks: DataFrame, folder: str) -> None:
    """Write the states of the days in ``tasks``; stored days that are not in it stay, the others are replaced whole."""
    states = daily_states(tasks).repartition("day").write.mode("overwrite")
    states.option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def stored_days(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The states of the days from ``first`` to ``last``, both included; only their folders are read."""
    states = spark.read.parquet(folder).withColumn("day", F.col("day").cast("bigint"))
    if first is not None:
        states = states.where(F.col("day") >= first)
    return states if last is None else states.where(F.col("day") <= last)


def merged_life_cycle_events(states: DataFrame) -> DataFrame:
    """As ``task_life_cycle_events`` over the rows of these days."""
    return states.groupBy("priority").agg(*[F.sum(c).alias(c) for c in LIFE_CYCLE]).orderBy(F.desc("priority"))


def merged_task_counts(states: DataFrame) -> DataFrame:
    """Estimated number of distinct tasks per priority; a task of several days counts once."""
    united = F.hll_sketch_estimate(F.hll_union_agg("tasks")).alias("estimated_task_count")
    return states.groupBy("priority").agg(united).orderBy(F.desc("priority"))


def merged_daily_schedule(states: DataFrame) -> DataFrame:
    """As ``daily_task_schedule`` over the rows of these days."""
    by = states.groupBy("day").agg(F.sum("scheduled_task_count").alias("task_schedule_count"))
    return by.where("task_schedule_count > 0").orderBy(F.desc("day"))
