"""Conversion of CSV parts to Parquet, over and over: each time only files that are new or changed are read.

A batch is a folder of its own below its table. It counts only once the table's ledger names it: the ledger is a
Parquet folder with one file per run, which lists the input files that each batch was made of (name, size, time) and
the batches it replaces. That file is written last, by one task, so a run that breaks off before leaves nothing
that a reader sees. A file that changed takes the batches it was in with it: their other files are
converted again beside it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.functions.columns import DAY
from tracemill.sources.files import read_table
from tracemill.sources.schemas import CLOCK, TABLES, Table
from tracemill.sources.trace import Trace

LEDGER = "_ledger"
_FILE = "path string, length long, modified long, batch string, replaces array<string>"
#: Files of one batch, at most: a changed file brings so many others with it.
BATCH_FILES = 1000


def input_files(spark: SparkSession, path: str, name_glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path, length, modified`` of the files in a folder, or with ``recursive`` below it; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path).select("path", "length", F.unix_micros("modificationTime").alias("modified"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ledger(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of all batches that count: those that no later run has replaced."""
    path = f"{folder}/{LEDGER}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], _FILE)
    entries = spark.read.schema(_FILE).parquet(path)
    gone = entries.select(F.explode("replaces").alias("batch")).distinct()
    return entries.join(gone, "batch", "left_anti").where("path IS NOT NULL").select("path", "length", "modified", "batch")


def _convert_table(spark: SparkSession, table: Table, source: str, folder: str, name_glob: str | None, recursive: bool, by_day: bool, options: dict) -> int:
    """Files of ``table`` that were read."""
    known = ledger(spark, folder, table.name)
    found = input_files(spark, source, name_glob, recursive)
    # Spark's readers list their input on the driver too: names, sizes and times are all that comes here.
    here = {r.path: r for r in found.collect()}
    then: dict[str, tuple] = {r.path: r for r in known.collect()}
    same = lambda p: p in then and (then[p].length, then[p].modified) == (here[p].length, here[p].modified)
    # A batch with a file that changed or went is replaced; what is left of it is read again.
    stale = {r.batch for p, r in then.items() if p not in here or not same(p)}
    new = sorted(p for p in here if not same(p) or then[p].batch in stale)
    entries = []
    for start in range(0, len(new), BATCH_FILES):
        paths, batch = new[start : start + BATCH_FILES], uuid.uuid4().hex
        _write_batch(read_table(spark, table, paths, **options), table, f"{folder}/{table.name}/batch={batch}", by_day)
        entries += [(p, here[p].length, here[p].modified, batch, None) for p in paths]
    if entries or stale:  # one file: readers see all of this run or nothing
        entries.append((None, None, None, None, sorted(stale)))
        spark.createDataFrame(entries, _FILE).coalesce(1).write.mode("append").parquet(f"{folder}/{LEDGER}/{table.name}")
    return len(new)


def _write_batch(parsed: DataFrame, table: Table, path: str, by_day: bool) -> None:
    """One pass over the files: good rows, and bad lines, if the parser keeps them, as ``good=false``."""
    kept = parsed if "bad_line" in parsed.columns else parsed.withColumn("bad_line", F.lit(None).cast("string"))
    good = F.col("bad_line").isNull()
    # Without days all rows are in the folder of no day, so that batches of either kind are read together.
    day = F.when(good & F.lit(by_day), F.floor(F.col(CLOCK[table.name]) / DAY))
    parts = kept.withColumns({"good": good, "day": day})
    parts.hint("rebalance", "good", "day").write.mode("overwrite").partitionBy("good", "day").parquet(path)


def convert_new(
    spark: SparkSession, source: str, folder: str, name_glob: str | None = None, recursive: bool = False,
    by_day: bool = False, **options,
) -> dict[str, int]:
    """Bring the trace in ``folder`` up to the CSV parts in ``source``; per table, how many files were read.

    ``by_day`` puts the rows of a run in one sub-folder per day. Options are those of the parser, the same each time. Files that went from the source go from the trace as well. What
    broken runs and replaced batches left is not read; :func:`sweep` deletes it.
    """
    source, folder = source.rstrip("/"), folder.rstrip("/")
    return {
        name: _convert_table(spark, table, f"{source}/{name}", folder, name_glob, recursive, by_day, options)
        for name, table in TABLES.items()
    }


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Delete the batches that do not count; no conversion or reader may run meanwhile."""
    folder, gone = folder.rstrip("/"), []
    for name in TABLES:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        counted = {r.batch for r in ledger(spark, folder, name).select("batch").distinct().collect()}
        for status in files.listStatus(place) if files.exists(place) else []:
            batch = status.getPath().getName().removeprefix("batch=")
            if batch != status.getPath().getName() and batch not in counted:
                files.delete(status.getPath(), True)
                gone.append(batch)
    return gone


class LedgerTrace(Trace):
    """The tables as :func:`convert_new` keeps them; with ``start`` or ``end`` only that range of time; where rows lie by day, only those days are read."""

    def __init__(self, spark: SparkSession, folder: str, start: int | None = None, end: int | None = None):
        super().__init__(spark)
        self.folder, self.start, self.end = folder.rstrip("/"), start, end

    def _batches(self, name: str) -> list[str]:
        batches = ledger(self.spark, self.folder, name).select("batch").distinct().collect()
        return [f"{self.folder}/{name}/batch={r.batch}" for r in batches]

    def _rows(self, table: Table) -> DataFrame:
        kind = table.schema.add("bad_line", "string").add("good", "boolean").add("day", "long")
        paths = self._batches(table.name)
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.folder}/{table.name}").parquet(*paths)

    def _table(self, table: Table) -> DataFrame:
        df, time, day = self._rows(table).where("good"), F.col(CLOCK[table.name]), F.col("day")
        # Rows that were not written by day have none.
        if self.start is not None:
            df = df.where((time >= self.start) & (day.isNull() | (day >= self.start // DAY)))
        if self.end is not None:
            df = df.where((time < self.end) & (day.isNull() | (day <= (self.end - 1) // DAY)))
        return df.select(*table.columns)

    def bad_lines(self, name: str) -> DataFrame:
        """Lines that could not be read, in a column ``line``, if the conversions kept them."""
        return self._rows(TABLES[name]).where("NOT good").select(F.col("bad_line").alias("line"))
