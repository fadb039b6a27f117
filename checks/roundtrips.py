"""Registered queries for readers and writers: a derived table goes out to files or text and comes back."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from checks.uneven import UnevenTrace
from tracemill.functions.columns import DAY
from tracemill.operators.aggregates import row_count
from tracemill.plans import machines, partials, tasks, usage
from tracemill.plans.catalog import ANALYSES
from tracemill.session import scratch_folder
from tracemill.sources.buckets import buckets_for, write_bucketed
from tracemill.sources.files import parse_lines, read_lines, read_table, read_utilization, table_lines
from tracemill.sources.ledger import LedgerTrace, convert_new
from tracemill.sources.output import write_csv, write_parquet
from tracemill.sources.schemas import JOB_EVENTS, MACHINE_EVENTS, TABLES, TASK_EVENTS
from tracemill.sources.trace import CsvTrace, ParquetTrace, Trace


#: Analyses that join or add up by task.
BY_TASK = ["resource_requested_used", "consumption_histogram", "task_attribute_lookup", "usage_with_request", "task_durations"]


#: Whose history is looked up.
MACHINE = 7


def _write_lines(lines: DataFrame, folder: str) -> str:
    lines.select("line").write.mode("overwrite").option("compression", "gzip").text(folder)
    return folder


def _table(name: str) -> Callable[[Trace], DataFrame]:
    def query(t: Trace) -> DataFrame:
        folder = _write_lines(table_lines(getattr(t, name), TABLES[name]), scratch_folder(t.spark, name))
        return read_table(t.spark, TABLES[name], folder)

    return query


def _raw_lines(t: Trace) -> DataFrame:
    return read_lines(t.spark, _write_lines(t.machine_attributes, scratch_folder(t.spark, "attributes")))


def _glob(t: Trace) -> DataFrame:
    folder = scratch_folder(t.spark, "job_events")
    for part, remainder in (("first", 0), ("second", 1)):
        half = t.job_events.where(F.col("job_id") % 2 == remainder)
        _write_lines(table_lines(half, JOB_EVENTS), f"{folder}/{part}")
    return read_table(t.spark, JOB_EVENTS, f"{folder}/[fs]*", name_glob="part-*")


def _defaults(t: Trace) -> DataFrame:
    """Task events with emptied fields."""
    job = F.col("job_id")
    emptied = t.task_events.withColumns({
        "event_type": F.when(job % 5 != 0, F.col("event_type")),
        "user": F.when(job % 3 != 0, F.col("user")),
        "priority": F.when(job % 4 != 0, F.col("priority")),
        "cpu_request": F.when(job % 7 != 0, F.col("cpu_request")),
    })
    return parse_lines(table_lines(emptied, TASK_EVENTS), TASK_EVENTS, zero_machine_id=True)


def _presence_flag(t: Trace) -> DataFrame:
    flag = "different_machine_restrictions"
    emptied = t.task_events.withColumn(flag, F.when(F.col("job_id") % 3 != 0, F.col(flag)))
    parsed = parse_lines(table_lines(emptied, TASK_EVENTS), TASK_EVENTS, presence_flags=True)
    return parsed.select("time", "job_id", "task_index", flag)


def _quarantine(t: Trace) -> DataFrame:
    """Machine events, some with letters in the time, some cut short, some with a field too many."""
    time, line = F.col("time"), F.col("line")
    lines = t.machine_events.withColumn("line", F.concat_ws(",", *MACHINE_EVENTS.columns))
    damaged = (
        F.when(time % 97 == 0, F.concat(F.lit("x"), line))
        .when(time % 89 == 0, F.substring_index(line, ",", 3))
        .when(time % 83 == 0, F.concat(line, F.lit(",more")))
        .otherwise(line)
    )
    return parse_lines(lines.select(damaged.alias("line")), MACHINE_EVENTS, mode="quarantine")


def _damaged_tasks(t: Trace) -> CsvTrace:
    """A trace whose task lines have, in places, letters in the time or are cut short."""
    folder = scratch_folder(t.spark, "damaged")
    lines = table_lines(t.task_events, TASK_EVENTS)
    time = F.split("line", ",")[0].cast("bigint")
    damaged = F.when(time % 97 == 0, F.concat(F.lit("x"), "line")).when(time % 89 == 0, F.substring_index("line", ",", 3))
    _write_lines(lines.select(damaged.otherwise(F.col("line")).alias("line")), f"{folder}/task_events")
    return CsvTrace(t.spark, folder, mode="quarantine")


#: A task of the sample tables has a few rows; with more than this it is hot here, so both parts have tasks.
_HOT_ROWS = 1


def _bucketed(name: str) -> Callable[[Trace], DataFrame]:
    """An analysis over task tables written in buckets, the rows of hot tasks apart."""
    def query(t: Trace) -> DataFrame:
        trace = UnevenTrace(t.spark, t.folder)
        buckets = buckets_for(trace.task_usage.count(), least=8)
        return ANALYSES[name](write_bucketed(trace, scratch_folder(t.spark, "bucketed"), buckets, _HOT_ROWS))

    return query


def _ledger(t: Trace) -> LedgerTrace:
    """Task and machine events that came in three deliveries; the second brings a file anew, with other rows."""
    source, folder = scratch_folder(t.spark, "deliveries"), scratch_folder(t.spark, "ledger")
    names = {"task_events": "job_id", "machine_events": "machine_id"}
    for name in TABLES:
        if name not in names:
            _write_lines(table_lines(getattr(t, name), TABLES[name]).limit(0), f"{source}/{name}")

    def deliver(name: str, third: int, rows: DataFrame) -> None:
        # Each third of the keys is a folder of files; the glob of the source takes all of them.
        _write_lines(table_lines(rows, TABLES[name]), f"{source}/{name}/third={third}")

    for step in range(3):
        for name, key in names.items():
            table = getattr(t, name)
            deliver(name, step, table.where(F.col(key) % 3 == step))
            if step == 0:  # the last third is wrong at first, and is delivered again in the last step
                deliver(name, 2, table.where(F.col(key) % 3 == 1))
        convert_new(t.spark, source, folder, recursive=True)
    return LedgerTrace(t.spark, folder)


def _clustered(t: Trace) -> ParquetTrace:
    """Machine events written with the rows of a machine next to each other."""
    folder = scratch_folder(t.spark, "clustered")
    write_parquet(t.machine_events, folder, "machine_events", cluster_by="machine_id")
    return ParquetTrace(t.spark, folder)


#: Sample times are folded into so many days, as a trace has; the first and last day of the merged range.
STORED_DAYS, FIRST_DAY, LAST_DAY = 30, 5, 24
#: Four times the relative error of a sketch.
SKETCH_BOUND = 0.032


def _folded(t: Trace) -> DataFrame:
    return t.task_events.withColumn("time", F.pmod("time", F.lit(STORED_DAYS * DAY)))


def _stored_days(t: Trace) -> DataFrame:
    """States of a range of days, stored in two deliveries; the second brings a day anew that the first had in part."""
    folder, middle = scratch_folder(t.spark, "days"), 15 * DAY
    events = _folded(t)
    partials.store_days(events.where((F.col("time") < middle) | ((F.col("time") < middle + DAY) & (F.col("job_id") % 2 == 0))), folder)
    partials.store_days(events.where(F.col("time") >= middle), folder)
    return partials.stored_days(t.spark, folder, FIRST_DAY, LAST_DAY)


def _stored_task_counts(t: Trace) -> DataFrame:
    """Exact distinct tasks of the range by priority, and whether the united sketches are within their bound."""
    inside = _folded(t).where(F.col("time").between(FIRST_DAY * DAY, (LAST_DAY + 1) * DAY - 1))
    exact = tasks.task_life_cycle(inside).select("priority", "distinct_task_count")
    off = F.abs(F.col("estimated_task_count") - F.col("distinct_task_count"))
    both = exact.join(partials.merged_task_counts(_stored_days(t)), "priority", "left")
    within = F.coalesce(off <= SKETCH_BOUND * F.col("distinct_task_count"), F.lit(False))
    return both.select("priority", "distinct_task_count", within.alias("within_bound"))


def _sql(t: Trace) -> DataFrame:
    t.register_views()
    return t.spark.sql("SELECT event_type, count(*) AS count FROM task_events GROUP BY event_type")


def _utilization(t: Trace) -> DataFrame:
    utilization = usage.machine_utilization(t.task_usage).withColumnRenamed("machine_utilization", "utilization")
    return read_utilization(t.spark, write_csv(utilization, scratch_folder(t.spark, "out"), "machine_utilization"))


def _sink(t: Trace, df: DataFrame, name: str, shuffle: bool) -> DataFrame:
    path = write_csv(df, scratch_folder(t.spark, "out"), name, one_file=True, shuffle=shuffle)
    return t.spark.read.schema(df.schema).option("header", True).csv(path)


ROUND_TRIPS: dict[str, Callable[[Trace], DataFrame]] = {
    **{f"src_{name}": _table(name) for name in TABLES},
    "src_raw_lines": _raw_lines,
    "src_raw_line_count": lambda t: row_count(_raw_lines(t)),
    "src_machine_utilization": _utilization,
    "src_glob": _glob,
    "parse_defaults": _defaults,
    "parse_presence_flag": _presence_flag,
    "parse_quarantine": _quarantine,
    "quarantine_life_cycle": lambda t: ANALYSES["task_life_cycle"](_damaged_tasks(t)),
    "quarantine_bad_lines": lambda t: _damaged_tasks(t).bad_lines("task_events"),
    "sql_event_types": _sql,
    "ledger_task_events": lambda t: _ledger(t).task_events,
    "ledger_machines_latest": lambda t: ANALYSES["machines_latest"](_ledger(t)),
    "clustered_machine_history": lambda t: machines.machine_history(_clustered(t).machine_events, MACHINE),
    "stored_life_cycle_events": lambda t: partials.merged_life_cycle_events(_stored_days(t)),
    "stored_daily_schedule": lambda t: partials.merged_daily_schedule(_stored_days(t)),
    "stored_task_counts": _stored_task_counts,
    **{f"bucketed_{name}": _bucketed(name) for name in BY_TASK},
    "parse_lines_roundtrip": lambda t: parse_lines(table_lines(t.job_events, JOB_EVENTS), JOB_EVENTS),
    "sink_csv_roundtrip": lambda t: _sink(t, tasks.task_life_cycle(t.task_events), "task_life_cycle", False),
    "sink_csv_repartition": lambda t: _sink(t, usage.machine_utilization(t.task_usage), "utilization", True),
}
