"""Conversions that go on where the last one ended, and lookups in what is clustered."""

import pyarrow.parquet as pq
import pytest
from pathlib import Path
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.tables import rows as in_order
from tracemill.plans.machines import machine_history
from tracemill.run import main
from tracemill.session import scratch_folder
from tracemill.sources import ledger
from tracemill.sources.output import write_parquet
from tracemill.sources.schemas import TABLES
from tracemill.sources.trace import CsvTrace, ParquetTrace, SampleTrace

SAMPLE = "/root/testdata/sf0.001"
DAY = 86_400_000_000


def rows(df):
    return sorted(in_order(df), key=repr)


def line(time, job=1):
    return f"{time},0,{job},2,3,1,u,0,7,0.5,0.5,0,1"


@pytest.fixture
def folders(spark, tmp_path):
    source, folder = tmp_path / "csv", tmp_path / "parquet"
    for name in TABLES:
        (source / name).mkdir(parents=True)
    return source / "task_events", source, folder


def convert(spark, folders, **options):
    _, source, folder = folders
    return ledger.convert_new(spark, f"file:{source}", f"file:{folder}", **options)["task_events"]


def jobs(spark, folders, **options):
    trace = ledger.LedgerTrace(spark, f"file:{folders[2]}", **options)
    return sorted(r.job_id for r in trace.task_events.select("job_id").collect())


def put(folders, name, *lines):
    (folders[0] / name).write_text("".join(f"{text}\n" for text in lines))


def test_only_new_files_are_read(spark, folders):
    put(folders, "a.csv", line(1, 1), line(DAY, 2))
    put(folders, "b.csv", line(2, 3))
    assert convert(spark, folders, by_day=True) == 2 and jobs(spark, folders) == [1, 2, 3]
    first = sorted(p.name for p in (folders[2] / "task_events").iterdir())
    assert convert(spark, folders) == 0
    put(folders, "c.csv", line(3 * DAY, 4))
    put(folders, "d.csv", line(4 * DAY, 5))
    assert convert(spark, folders, name_glob="[abc].csv", by_day=True) == 1 and jobs(spark, folders) == [1, 2, 3, 4]
    assert convert(spark, folders) == 1
    assert set(first) < {p.name for p in (folders[2] / "task_events").iterdir()}
    assert jobs(spark, folders, start=DAY) == [2, 4, 5] and jobs(spark, folders, start=1, end=DAY) == [1, 3]
    trace = ledger.LedgerTrace(spark, f"file:{folders[2]}", start=2 * DAY)
    filters = trace.task_events._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert "day" in filters.split("]")[0]


def test_changed_and_removed_files(spark, folders, monkeypatch):
    monkeypatch.setattr(ledger, "BATCH_FILES", 2)
    for i in range(5):
        put(folders, f"f{i}.csv", line(i, 10 + i))
    assert convert(spark, folders) == 5
    put(folders, "f0.csv", line(0, 20), line(0, 21))
    assert convert(spark, folders) == 2 and jobs(spark, folders) == [11, 12, 13, 14, 20, 21]
    (folders[0] / "f4.csv").unlink()
    assert convert(spark, folders) == 0 and jobs(spark, folders) == [11, 12, 13, 20, 21]
    batches = {p.name for p in (folders[2] / "task_events").iterdir() if p.is_dir()}
    assert len(ledger.sweep(spark, f"file:{folders[2]}")) == 2 and jobs(spark, folders) == [11, 12, 13, 20, 21]
    assert len({p.name for p in (folders[2] / "task_events").iterdir() if p.is_dir()}) == len(batches) - 2


def test_a_broken_run_leaves_nothing_behind(spark, folders, monkeypatch):
    monkeypatch.setattr(ledger, "BATCH_FILES", 1)
    put(folders, "a.csv", line(1, 1))
    assert convert(spark, folders) == 1
    put(folders, "b.csv", line(1, 2))
    put(folders, "c.csv", "no such line")
    with pytest.raises(PySparkException, match="cannot be read"):
        convert(spark, folders)
    assert jobs(spark, folders) == [1]
    put(folders, "c.csv", line(1, 3))
    assert convert(spark, folders) == 2 and jobs(spark, folders) == [1, 2, 3]
    assert len(ledger.sweep(spark, f"file:{folders[2]}")) >= 1 and jobs(spark, folders) == [1, 2, 3]


def test_bad_lines_come_from_the_same_pass(spark, folders):
    put(folders, "a.csv", line(1, 1), "bad one")
    assert convert(spark, folders, mode="quarantine") == 1
    put(folders, "b.csv", "bad two", line(2, 2))
    assert convert(spark, folders, mode="quarantine") == 1
    trace = ledger.LedgerTrace(spark, f"file:{folders[2]}")
    assert jobs(spark, folders) == [1, 2] and rows(trace.bad_lines("task_events")) == [("bad one",), ("bad two",)]
    plain = CsvTrace(spark, f"file:{folders[1]}", mode="quarantine")
    assert rows(trace.task_events) == rows(plain.task_events)
    assert trace.machine_events.count() == 0 and trace.task_usage.columns == TABLES["task_usage"].columns


def test_command_line(spark, folders, capsys):
    put(folders, "a.csv", line(1, 1))
    main(["--trace", f"file:{folders[1]}", "--out", f"file:{folders[2]}", "--convert", "--new"])
    assert "task_events=1" in capsys.readouterr().out
    out = folders[2].parent / "out"
    main(["--trace", f"file:{folders[2]}", "--format", "ledger", "--out", f"file:{out}", "--only", "row_count"])
    assert spark.read.option("header", True).csv(f"file:{out}/row_count").first()[0] == "1"
    main(["--trace", f"file:{folders[2]}", "--format", "ledger", "--out", f"file:{out}/b", "--convert", "--buckets", "2"])
    main(["--trace", f"file:{out}/b", "--format", "bucketed", "--out", f"file:{out}", "--only", "task_usage_max"])


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    """Of the row groups of a table of 200,000 events, one machine's lookup has to look into less than a tenth."""
    machines = spark.range(200_000, numPartitions=8).select(
        (F.col("id") % DAY).alias("time"), (F.xxhash64("id") % 5000).alias("machine_id"), F.lit(2).cast("long").alias("event_type"),
        F.md5(F.col("id").cast("string")).alias("platform_id"), F.lit(0.5).alias("cpu"), F.rand(1).alias("memory"),
    )
    write_parquet(machines, f"file:{tmp_path}", "plain")
    write_parquet(machines, f"file:{tmp_path}", "machine_events", cluster_by="machine_id", row_group=1 << 18)
    wanted = machines.first().machine_id

    def looked_into(name):
        touched = total = 0
        for file in Path(tmp_path / name).glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            at = meta.schema.names.index("machine_id")
            for group in range(meta.num_row_groups):
                stats = meta.row_group(group).column(at).statistics
                total += 1
                touched += stats.min <= wanted <= stats.max
        return touched, total

    touched, total = looked_into("machine_events")
    assert total > 20 and 1 <= touched <= max(2, total // 10)
    assert looked_into("plain")[0] == looked_into("plain")[1]
    trace = ParquetTrace(spark, f"file:{tmp_path}")
    assert rows(machine_history(trace.machine_events, wanted)) == rows(machines.where(F.col("machine_id") == wanted))


@pytest.mark.parametrize("by_day", [False, True])
def test_conversion_by_machine_keeps_the_tables(spark, by_day):
    class FewDays(SampleTrace):
        job_events = property(lambda self: super().job_events.where(F.col("time") < 5 * DAY))
        task_events = property(lambda self: super().task_events.where(F.col("time") < 20 * DAY))
        task_usage = property(lambda self: super().task_usage.where(F.col("start_time") < 20 * DAY))

    trace = FewDays(spark, SAMPLE)
    converted = trace.convert(scratch_folder(spark, "by_machine"), by_day, by_machine=True)
    for name in TABLES:
        assert rows(getattr(trace, name)) == rows(getattr(converted, name))
