"""The trace tables: column order and types of their headerless CSV files, and the event codes."""

from dataclasses import dataclass

from pyspark.sql import types as T

SPARK_TYPES = {
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "flag": T.BooleanType(),
}


@dataclass(frozen=True)
class Field:
    """A column; ``missing`` tells what an empty text field becomes.

    "error": the line is bad. "zero": 0. "blank": the empty string. "null": null.
    """

    name: str
    type: str
    missing: str


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type]) for f in self.fields])


def _key(*names):
    return tuple(Field(n, "long", "error") for n in names)


def _count(*names):
    return tuple(Field(n, "long", "zero") for n in names)


def _measure(*names):
    return tuple(Field(n, "double", "zero") for n in names)


def _text(*names):
    return tuple(Field(n, "string", "blank") for n in names)


def _flag(*names):
    return tuple(Field(n, "flag", "null") for n in names)


# Column names and their order in the trace files.
MACHINE_EVENTS = Table(
    "machine_events",
    _key("time", "machine_id", "event_type") + _text("platform_id") + _measure("cpu", "memory"),
)
JOB_EVENTS = Table(
    "job_events",
    _key("time") + _count("missing_info") + _key("job_id") + _count("event_type") + _text("user")
    + _count("scheduling_class") + _text("job_name", "logical_job_name"),
)
# An event without a machine keeps a null id: a shared stand-in id would be one hot join key.
TASK_EVENTS = Table(
    "task_events",
    _key("time") + _count("missing_info") + _key("job_id", "task_index")
    + (Field("machine_id", "long", "null"),) + _count("event_type") + _text("user")
    + _count("scheduling_class", "priority")
    + _measure("cpu_request", "memory_request", "disk_space_request")
    + _flag("different_machine_restrictions"),
)
TASK_USAGE = Table(
    "task_usage",
    _key("start_time", "end_time", "job_id", "task_index", "machine_id")
    + _measure(
        "cpu_rate", "canonical_memory_usage", "assigned_memory_usage", "unmapped_page_cache",
        "total_page_cache", "maximum_memory_usage", "disk_io_time", "local_disk_space_usage",
        "maximum_CPU_rate", "maximum_disk_IO_time", "cycles_per_instruction",
        "memory_accesses_per_instruction", "sample_portion",
    )
    + _flag("aggregation_type") + _measure("sampled_CPU_usage"),
)
MACHINE_UTILIZATION = Table(
    "machine_utilization", _key("machine_id") + _measure("utilization"),
)

TABLES = {t.name: t for t in (MACHINE_EVENTS, JOB_EVENTS, TASK_EVENTS, TASK_USAGE)}
# The column by which a table is put in days.
CLOCK = {name: "start_time" if name == "task_usage" else "time" for name in TABLES}

# Event codes of jobs and tasks.
SUBMITTED, SCHEDULED, EVICTED, FAILED, FINISHED, KILLED, LOST, UPDATE_PENDING, UPDATE_RUNNING = range(9)
# Event codes of machines.
ADDED, REMOVED, UPDATED = range(3)
