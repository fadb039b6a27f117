"""Task tables laid out for joins by task: bucketed and sorted by (job, index), both in the same number of buckets.

Joins and aggregates by task then read bucket by bucket, without a shuffle. A bucket is one task, so a
task with very many rows would make one slow: the rows of hot tasks lie apart, in both tables, and are joined
by a shuffle that Spark can split.
"""

from __future__ import annotations

import uuid
from functools import cached_property
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.operators.joins import BROADCAST_BYTES, fits_broadcast, lookup_join
from tracemill.sources.output import write_parquet
from tracemill.sources.schemas import CLOCK, JOB_EVENTS, MACHINE_EVENTS, TASK_EVENTS, TASK_USAGE, Table
from tracemill.sources.trace import Trace

TASK_KEY = ["job_id", "task_index"]
BUCKETED = (TASK_EVENTS, TASK_USAGE)
#: A task with more rows than this in either table is hot.
HOT_ROWS = 1_000_000
LAYOUT, HOT = "_layout", "hot"
_LAYOUT = "buckets int, hot_tasks long, beside boolean"
#: Rows of a bucket that one task sorts in memory.
BUCKET_ROWS = 500_000


def hot_tasks(trace: Trace, rows: int = HOT_ROWS) -> DataFrame:
    """``job_id, task_index`` of tasks with more than ``rows`` rows in one of the tables: at most one per ``rows`` rows of each."""
    return _hot_counts(trace, rows).select(*TASK_KEY)


def _hot_counts(trace: Trace, rows: int) -> DataFrame:
    """The hot tasks with ``n``, their rows in the table that has more of them; both tables are counted in one shuffle."""
    events, usage = (getattr(trace, t.name).select(*TASK_KEY, F.lit(t is TASK_USAGE).alias("_usage")) for t in BUCKETED)
    n = F.greatest(F.count_if(~F.col("_usage")), F.count_if("_usage")).alias("n")
    return events.union(usage).groupBy(*TASK_KEY).agg(n).where(F.col("n") > rows)


def buckets_for(rows: int, least: int = 1) -> int:
    """Buckets of a table of ``rows`` rows, so that each is sorted in memory."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_bucketed(trace: Trace, folder: str, buckets: int, hot_rows: int = HOT_ROWS) -> BucketedTrace:
    """Write the tables of ``trace``, those of tasks in ``buckets`` files each and, apart, the rows of hot tasks.

    Every task table is shuffled once, by the hash that buckets use, so a bucket is one sorted file. Hot tasks that can
    be broadcast stay out of the shuffle. Where there are too many, those of up to ``HOT_ROWS`` rows are told apart
    in it: their keys are dealt in the same way, and their rows lie beside the buckets, in ``hot=true``.
    """
    spark, folder = trace.spark, folder.rstrip("/")
    write_parquet(_hot_counts(trace, hot_rows), f"{folder}/{HOT}", "tasks")
    hot = spark.read.parquet(f"{folder}/{HOT}/tasks").withColumn("_hot", F.lit(True))
    n_hot = hot.count()
    beside = not fits_broadcast(hot.drop("n"))
    apart = (hot.where(F.col("n") > HOT_ROWS) if beside else hot).drop("n")
    n_apart = apart.count() if beside else n_hot
    for table in BUCKETED:
        rows = getattr(trace, table.name)
        if n_apart:
            marked = lookup_join(rows, apart, TASK_KEY, "left", BROADCAST_BYTES)
            write_parquet(marked.where("_hot").select(*table.columns), f"{folder}/{HOT}", table.name)
            rows = marked.where("_hot IS NULL").select(*table.columns)
        dealt = rows.repartition(buckets, *TASK_KEY)
        if beside:
            met = hot.where(F.col("n") <= HOT_ROWS).drop("n").repartition(buckets, *TASK_KEY)
            dealt = dealt.join(met, TASK_KEY, "left").select(*table.columns, F.col("_hot").isNotNull().alias(HOT))
        _write(dealt, f"{folder}/{table.name}", buckets, [HOT] if beside else [])
    for table in (MACHINE_EVENTS, JOB_EVENTS):
        write_parquet(getattr(trace, table.name), folder, table.name)
    # Last, so that a folder without it is not taken for a trace.
    layout = spark.range(1, numPartitions=1).select(F.lit(buckets).alias("buckets"), F.lit(n_hot).cast("long").alias("hot_tasks"), F.lit(beside).alias("beside"))
    write_parquet(layout, folder, LAYOUT)
    return BucketedTrace(spark, folder)


def _write(rows: DataFrame, path: str, buckets: int, parts: list[str]) -> None:
    name = f"tracemill_{uuid.uuid4().hex}"
    writer = rows.write.mode("overwrite").option("path", path).bucketBy(buckets, *TASK_KEY).sortBy(*TASK_KEY)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # it is external: the files stay
    for part in parts:  # also where all tasks are hot
        place = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}=false")
        place.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(place)


def _bucketed_table(spark: SparkSession, table: Table, path: str, buckets: int) -> DataFrame:
    """The files in ``path`` as a table that tells Spark how they are bucketed."""
    name = f"tracemill_{table.name}_{md5(f'{path} {buckets}'.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        keys = ", ".join(TASK_KEY)
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)


class _Part(Trace):
    """The rows of the hot tasks, or of all others; ``colocated`` if joins by task need no shuffle."""

    def __init__(self, whole: BucketedTrace, hot: bool):
        super().__init__(whole.spark)
        self.whole, self.hot, self.colocated = whole, hot, not hot

    def _table(self, table: Table) -> DataFrame:
        if table not in BUCKETED:
            return getattr(self.whole, table.name)
        path = f"{self.whole.folder}/{table.name}"
        if not self.hot:
            df = _bucketed_table(self.spark, table, f"{path}/{HOT}=false" if self.whole.beside else path, self.whole.buckets)
        elif self.whole.beside:
            df = self.spark.read.schema(table.schema.add(HOT, "boolean")).parquet(path).where(HOT).select(*table.columns)
            if _exists(self.spark, f"{self.whole.folder}/{HOT}/{table.name}"):
                df = df.unionByName(self._apart(table))
        else:
            df = self._apart(table)
        return self.whole.ranged(df, table).select(*table.columns)

    def _apart(self, table: Table) -> DataFrame:
        return self.spark.read.schema(table.schema).parquet(f"{self.whole.folder}/{HOT}/{table.name}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class BucketedTrace(Trace):
    """The tables as :func:`write_bucketed` wrote them; with ``start`` or ``end`` only rows of that range of time.

    ``task_parts`` are the two parts whose tasks do not overlap; an analysis by task is that of each part.
    """

    def __init__(self, spark: SparkSession, folder: str, start: int | None = None, end: int | None = None):
        super().__init__(spark)
        self.folder, self.start, self.end = folder.rstrip("/"), start, end

    @cached_property
    def _layout(self):
        return self.spark.read.schema(_LAYOUT).parquet(f"{self.folder}/{LAYOUT}").first()

    @property
    def buckets(self) -> int:
        return self._layout.buckets

    @property
    def beside(self) -> bool:
        """Whether rows of hot tasks lie beside the buckets, in ``hot=true``."""
        return bool(self._layout.beside)

    @cached_property
    def task_parts(self) -> list[Trace]:
        return [_Part(self, hot=False), *([_Part(self, hot=True)] if self._layout.hot_tasks else [])]

    def ranged(self, df: DataFrame, table: Table) -> DataFrame:
        time = F.col(CLOCK[table.name])
        df = df if self.start is None else df.where(time >= self.start)
        return df if self.end is None else df.where(time < self.end)

    def _table(self, table: Table) -> DataFrame:
        if table not in BUCKETED:
            return self.ranged(self.spark.read.schema(table.schema).parquet(f"{self.folder}/{table.name}"), table).select(*table.columns)
        parts = [getattr(p, table.name) for p in self.task_parts]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
