"""Registered queries over sample tables in which one job, task and machine hold a third of the rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.compare import duckdb_over, duckdb_rows, spark_rows
from tracemill.session import scratch_folder

SAMPLE = "/root/testdata/sf0.001"
QUERIES = [
    "task_life_cycle", "tasks_per_job", "tasks_per_job_summary", "task_durations", "task_attributes",
    "priority_capacity", "priority_capacity_share", "machine_task_counts", "broadcast_machine_lookup",
    "task_attribute_lookup", "resource_requested_used", "resource_requested_used_per_task", "consumption_histogram",
    "machine_utilization", "usage_with_request", "reconfigured_machine_events", "machines_latest",
]


@pytest.fixture(scope="module")
def folder(spark):
    folder = scratch_folder(spark, "uneven")
    third = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(3)) == 0
    lines = spark.read.parquet(f"{SAMPLE}/lineitem.parquet").repartition(6, "l_partkey")
    hot = third("l_orderkey", "l_linenumber", "l_partkey")
    lines.withColumns({
        "l_orderkey": F.when(hot, 5).otherwise(F.col("l_orderkey")),
        "l_linenumber": F.when(hot, 1).otherwise(F.col("l_linenumber")),
        "l_suppkey": F.when(hot, 3).otherwise(F.col("l_suppkey")),
    }).write.parquet(f"{folder}/lineitem.parquet")
    events = spark.read.parquet(f"{SAMPLE}/events.parquet")
    events.withColumn("user_id", F.when(third("event_id"), 8).otherwise(F.col("user_id"))).write.parquet(
        f"{folder}/events.parquet")
    spark.read.parquet(f"{SAMPLE}/orders.parquet").write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.fixture
def shuffled(spark, monkeypatch):
    """No broadcast, neither counted nor planned."""
    monkeypatch.setattr("tracemill.sources.trace.BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", QUERIES)
def test_equals_duckdb(spark, folder, shuffled, name):
    con = duckdb_over(folder, "/*.parquet")
    df = contract.queries()[name](spark, folder)
    assert spark_rows(df) == duckdb_rows(con, contract.oracle_sql()[name])
