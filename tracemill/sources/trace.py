"""A trace is five tables; here from CSV files, from Parquet, or derived from star-schema sample tables."""

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.functions.columns import DAY, SECOND
from tracemill.operators.joins import BROADCAST_BYTES, fits_broadcast, lookup_join
from tracemill.sources.files import read_lines, read_table
from tracemill.sources.output import write_parquet
from tracemill.sources.schemas import CLOCK, JOB_EVENTS, MACHINE_EVENTS, TABLES, TASK_EVENTS, TASK_USAGE, Table


class Trace:
    """Base: sub-classes give each table on demand. Tables are lazy and never cached here."""

    #: Whether both task tables are bucketed by task, so that joins by task need no shuffle.
    colocated = False

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._kept: dict[str, DataFrame] | None = None
        self._keep: frozenset[str] | None = None

    @property
    def task_parts(self) -> list["Trace"]:
        """Traces whose tasks do not overlap and are together all tasks of this one."""
        return [self]

    @contextmanager
    def sharing(self, only: Iterable[str] | None = None) -> Iterator[None]:
        """Within the block, what analyses share is kept, in memory or on disk, and computed once; with ``only``, what it names."""
        self._kept = {}
        self._keep = None if only is None else frozenset(only)
        try:
            yield
        finally:
            kept, self._kept = self._kept, None
            for df in kept.values():
                df.unpersist()

    def shared(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``make``; while sharing, the one that was made first under that name."""
        if self._kept is None or (self._keep is not None and name not in self._keep):
            return make()
        if name not in self._kept:
            self._kept[name] = make().persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[name]

    def _table(self, table: Table) -> DataFrame:
        raise NotImplementedError

    @cached_property
    def machine_events(self) -> DataFrame:
        return self._table(MACHINE_EVENTS)

    @cached_property
    def job_events(self) -> DataFrame:
        return self._table(JOB_EVENTS)

    @cached_property
    def task_events(self) -> DataFrame:
        return self._table(TASK_EVENTS)

    @cached_property
    def task_usage(self) -> DataFrame:
        return self._table(TASK_USAGE)

    @property
    def machine_attributes(self) -> DataFrame:
        raise NotImplementedError

    def tasks(self, *columns: str) -> DataFrame:
        """Task events with only these columns."""
        return self.task_events.select(*columns)

    def register_views(self) -> None:
        """Temporary views for SQL, with the misspelt name that older queries use beside the right one."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(name)
        self.machine_events.createOrReplaceTempView("macine_events")

    def _to_convert(self, table: Table) -> DataFrame:
        """The rows that a conversion writes."""
        return getattr(self, table.name)

    def convert(
        self, folder: str, by_day: bool = False, attributes: bool = False, by_machine: bool = False
    ) -> "ParquetTrace":
        """Write the four typed tables as Parquet once, so that later scans prune columns and row groups.

        ``by_day`` puts every table in one sub-folder per day, so that a range of time reads its days
        only. ``by_machine`` puts the rows of a machine next to each other, within a day if there are days, so that
        looking up one machine reads few row groups. ``attributes`` also writes the lines of machine_attributes.
        """
        for name, table in TABLES.items():
            rows = self._to_convert(table)
            if by_day:
                rows = rows.withColumn("day", F.floor(F.col(CLOCK[name]) / DAY))
            parts = [c for c in ("good", "day") if c in rows.columns]
            cluster = "machine_id" if by_machine and "machine_id" in rows.columns else None
            write_parquet(rows, folder, name, partition_by=parts, cluster_by=cluster)
        if attributes:
            write_parquet(self.machine_attributes, folder, "machine_attributes")
        return ParquetTrace(self.spark, folder)


class CsvTrace(Trace):
    """Headerless CSV parts, gzip or plain, in one sub-folder per table; options as in :func:`parse_lines`.

    With ``mode="quarantine"`` the tables hold the good lines only; :meth:`bad_lines` has the others.
    """

    def __init__(self, spark: SparkSession, folder: str, name_glob: str | None = None, **options):
        super().__init__(spark)
        self.folder, self.name_glob, self.options = folder.rstrip("/"), name_glob, options

    def _parsed(self, table: Table) -> DataFrame:
        return read_table(self.spark, table, f"{self.folder}/{table.name}", self.name_glob, **self.options)

    def _table(self, table: Table) -> DataFrame:
        parsed = self._parsed(table)
        return parsed.where("bad_line IS NULL").select(*table.columns) if self._quarantined else parsed

    @property
    def _quarantined(self) -> bool:
        return self.options.get("mode") == "quarantine"

    def bad_lines(self, name: str) -> DataFrame:
        """Lines of a table that cannot be read, in a column ``line``; only with ``mode="quarantine"``."""
        if not self._quarantined:
            raise ValueError("bad lines are kept in quarantine mode only")
        return self._parsed(TABLES[name]).where("bad_line IS NOT NULL").select(F.col("bad_line").alias("line"))

    def _to_convert(self, table: Table) -> DataFrame:
        """In quarantine mode good rows and bad lines, told apart by ``good``, so that one pass over the files writes both."""
        return self._parsed(table).withColumn("good", F.col("bad_line").isNull()) if self._quarantined else super()._to_convert(table)

    @cached_property
    def machine_attributes(self) -> DataFrame:
        return read_lines(self.spark, f"{self.folder}/machine_attributes", self.name_glob)


class ParquetTrace(Trace):
    """The tables as :meth:`Trace.convert` wrote them.

    With ``start`` or ``end`` (microseconds, the end not included), only rows of that range of time;
    of tables that lie in a folder per day, only those days are read.
    """

    def __init__(self, spark: SparkSession, folder: str, start: int | None = None, end: int | None = None):
        super().__init__(spark)
        self.folder, self.start, self.end = folder.rstrip("/"), start, end

    def _rows(self, table: Table) -> DataFrame:
        # Of the last three, a table has those that its conversion had a use for; the others are null.
        kind = table.schema.add("bad_line", "string").add("good", "boolean").add("day", "long")
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{table.name}")

    def _table(self, table: Table) -> DataFrame:
        time, day = F.col(CLOCK[table.name]), F.col("day")
        df = self._rows(table).where("good IS NULL OR good")
        if self.start is not None:
            df = df.where((time >= self.start) & (day.isNull() | (day >= self.start // DAY)))
        if self.end is not None:
            df = df.where((time < self.end) & (day.isNull() | (day <= (self.end - 1) // DAY)))
        return df.select(*table.columns)

    @cached_property
    def machine_attributes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/machine_attributes")

    def bad_lines(self, name: str) -> DataFrame:
        """Lines that a quarantine trace kept apart when it was converted, in a column ``line``."""
        return self._rows(TABLES[name]).where("NOT good").select(F.col("bad_line").alias("line"))


def _days(timestamp: str, first: str = "1995-01-01") -> Column:
    day = F.datediff(F.col(timestamp).cast("date"), F.lit(first).cast("date"))
    return day.cast("bigint") * DAY


def _fraction(whole: Column, divisor: int = 64) -> Column:
    """Fractions of a power of two, so that sums of doubles are exact in any order."""
    return whole.cast("double") / divisor


class SampleTrace(Trace):
    """The trace tables as views over ``events``, ``orders`` and ``lineitem`` Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder.rstrip("/")

    def _parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _event_time() -> Column:
        """Microseconds since the start of 2024, field by field, so that no session time zone comes in."""
        minutes = F.hour("ts").cast("bigint") * 60 + F.minute("ts")
        seconds = F.extract(F.lit("SECOND"), F.col("ts"))
        return _days("ts", "2024-01-01") + minutes * 60 * SECOND + (seconds * SECOND).cast("bigint")

    @cached_property
    def machine_events(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id")
        return self._parquet("events").select(
            self._event_time().alias("time"),
            user.alias("machine_id"),
            F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 1).otherwise(2)
            .cast("bigint").alias("event_type"),
            F.concat(F.lit("P"), (user % 3).cast("string")).alias("platform_id"),
            F.when(event % 29 == 0, 0.25).when(event % 3 == 0, 1.0).otherwise(0.5).alias("cpu"),
            _fraction(event % 4 + 1, 4).alias("memory"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        job, status = F.col("o_orderkey"), F.col("o_orderstatus")
        return self._parquet("orders").select(
            (_days("o_orderdate") + job).alias("time"),
            (job % 2).alias("missing_info"),
            job.alias("job_id"),
            F.when(status == "O", 1).when(status == "F", 4).when(job % 5 == 0, 2).otherwise(5)
            .cast("bigint").alias("event_type"),
            F.col("o_custkey").cast("string").alias("user"),
            (job % 4).alias("scheduling_class"),
            F.concat(F.lit("job-"), (job % 1000).cast("string")).alias("job_name"),
            F.concat(F.lit("logical-"), F.col("o_custkey").cast("string")).alias("logical_job_name"),
        )

    @cached_property
    def task_events(self) -> DataFrame:
        return self._task_events(with_orders=True)

    def tasks(self, *columns: str) -> DataFrame:
        """Without the join with ``orders`` when no asked column comes from it."""
        return self._task_events(with_orders="user" in columns or "priority" in columns).select(*columns)

    @cached_property
    def _orders(self) -> DataFrame:
        return self._parquet("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            "o_custkey",
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority"),
        )

    @cached_property
    def _orders_fit(self) -> bool:
        """Counted once per trace, by a job."""
        return BROADCAST_BYTES > 0 and fits_broadcast(self._orders, BROADCAST_BYTES)

    def _task_events(self, with_orders: bool) -> DataFrame:
        order, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("bigint")
        source = self._parquet("lineitem")
        if with_orders:
            if self._orders_fit:
                source = source.join(F.broadcast(self._orders), "l_orderkey", "left")
            else:
                source = lookup_join(source, self._orders, ["l_orderkey"], "left")
        columns = {
            "time": _days("l_shipdate") + line * 1_000_000 + part,
            "missing_info": F.lit(0).cast("bigint"),
            "job_id": order,
            "task_index": line,
            "machine_id": F.when(part % 11 != 0, F.col("l_suppkey")),
            "event_type": (order * 7 + line * 3 + part) % 9,
            "user": F.col("o_custkey").cast("string"),
            "scheduling_class": order % 4,
            "priority": F.col("priority"),
            "cpu_request": _fraction(F.col("l_quantity")),
            "memory_request": _fraction(part % 64),
            "disk_space_request": _fraction(F.col("l_suppkey") % 16),
            "different_machine_restrictions": part % 5 == 0,
        }
        if not with_orders:
            del columns["user"], columns["priority"]
        return source.select(*[c.alias(n) for n, c in columns.items()])

    @cached_property
    def task_usage(self) -> DataFrame:
        order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
        line = F.col("l_linenumber").cast("bigint")
        start = _days("l_shipdate")
        columns = {
            "start_time": start,
            "end_time": start + (F.col("l_quantity") * 6_000_000).cast("bigint"),
            "job_id": order,
            "task_index": line,
            "machine_id": supplier,
            "cpu_rate": _fraction(part % 32),
            "canonical_memory_usage": _fraction(supplier % 32),
            "assigned_memory_usage": _fraction(part % 8),
            "unmapped_page_cache": _fraction(line),
            "total_page_cache": _fraction(line, 32),
            "maximum_memory_usage": _fraction(supplier % 48),
            "disk_io_time": _fraction(order % 8),
            "local_disk_space_usage": _fraction(supplier % 8),
            "maximum_CPU_rate": _fraction(order % 48),
            "maximum_disk_IO_time": _fraction(order % 4),
            "cycles_per_instruction": _fraction(part % 256),
            "memory_accesses_per_instruction": _fraction(supplier % 128),
            "sample_portion": F.lit(1.0),
            "aggregation_type": line % 2 == 1,
            "sampled_CPU_usage": _fraction(order % 16),
        }
        return self._parquet("lineitem").select(*[c.alias(n) for n, c in columns.items()])

    @cached_property
    def machine_attributes(self) -> DataFrame:
        return self._parquet("events").select(
            F.concat_ws(",", self._event_time().cast("string"), F.col("user_id").cast("string"),
                        "event_type", "props").alias("line")
        )
