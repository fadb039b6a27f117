"""What the plans must look like to hold on large and uneven data."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.tables import machine_events, rows
from tracemill.operators import as_of_join, fits_broadcast, lookup_join, six_number_summary
from tracemill.operators.aggregates import from_ordered_bits, ordered_bits
from tracemill.plans import placement, tasks, usage
from tracemill.plans.catalog import ANALYSES
from tracemill.sources.trace import SampleTrace

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Set options for one test."""
    changed = []

    def setting(**options):
        for name, value in options.items():
            key = "spark.sql." + name.replace("__", ".")
            changed.append((key, spark.conf.get(key, None)))
            spark.conf.set(key, value)

    yield setting
    for key, value in reversed(changed):
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def many_tasks(conf):
    """Shuffle joins over 64 tasks that are neither merged nor split at run time."""
    conf(autoBroadcastJoinThreshold="-1", shuffle__partitions="64", adaptive__skewJoin__enabled="false",
         adaptive__coalescePartitions__enabled="false")


@pytest.fixture
def split_tasks(many_tasks, conf):
    """The same, but Spark splits what is too large at run time, from small sizes on."""
    conf(adaptive__skewJoin__enabled="true", adaptive__skewJoin__skewedPartitionFactor="2",
         adaptive__skewJoin__skewedPartitionThresholdInBytes="64k", adaptive__advisoryPartitionSizeInBytes="256k")


def largest_task_share(df):
    """Part of the rows of ``df`` that comes from one task of its last stage; all columns are read."""
    by_task = df.groupBy(F.spark_partition_id()).agg(F.count("*"), *[F.max(c) for c in df.columns])
    counts = [r[1] for r in rows(by_task)]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_no_python_no_cross_join(spark, name):
    plan = physical(ANALYSES[name](SampleTrace(spark, FOLDER)))
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("name, columns", [
    ("tasks_per_job", {"l_orderkey", "l_linenumber"}),
    ("distinct_jobs", {"o_orderkey"}),
    ("machine_utilization", {"l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"}),
])
def test_scan_reads_only_what_is_used(spark, name, columns):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", physical(ANALYSES[name](SampleTrace(spark, FOLDER))))
    assert [set(re.sub(r"#\d+L?", "", s).split(",")) for s in scans] == [columns]


@pytest.mark.parametrize("name, scans", [
    ("task_durations", 1), ("task_event_totals", 1), ("machine_dist_cpu", 1), ("task_life_cycle_events", 2),
    ("priority_capacity", 3), ("unutilized_machine_count", 2),
])
def test_each_table_is_read_once(spark, name, scans):
    assert physical(ANALYSES[name](SampleTrace(spark, FOLDER))).count("FileScan") == scans


def test_share_takes_its_total_from_the_counts(spark, conf):
    df = ANALYSES["machine_dist_capacity"](SampleTrace(spark, FOLDER))
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in physical(df) or final.count("FileScan") == 1


def uneven_facts(spark, n=600_000):
    """A third of the rows carries one key."""
    i = F.col("id")
    return spark.range(n, numPartitions=16).select(
        F.when(i % 3 == 0, 7).otherwise(i % 20_000).alias("k"), F.xxhash64("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_is_spread_over_tasks(spark, split_tasks, how):
    facts = uneven_facts(spark)
    dim = spark.range(100_000).groupBy((F.col("id") % 20_000).alias("k")).agg(F.max("id").alias("m"))
    salted, plain = lookup_join(facts, dim, ["k"], how), facts.join(dim, "k", how)
    assert salted.columns == plain.columns
    totals = lambda df: rows(df.agg(F.count("*"), F.sum("k"), F.bit_xor("v"), F.sum("m")))
    assert totals(salted) == totals(plain)
    assert largest_task_share(salted) < 0.2


def test_rows_without_a_key_are_spread_over_tasks(spark, split_tasks):
    facts = uneven_facts(spark).withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    dim = spark.range(20_000).select(F.col("id").alias("k"), F.col("id").alias("m"))
    joined = lookup_join(facts, dim, ["k"], "left")
    assert rows(joined.agg(F.count("*"), F.count("k"), F.count("m")))[0] == (600_000, *(facts.where("k is not null").count(),) * 2)
    assert largest_task_share(joined) < 0.2


def test_lookup_of_nothing(spark):
    facts = spark.range(3000, numPartitions=4).select((F.col("id") % 20).alias("k"), F.col("id").alias("_spread"))
    dim = spark.range(15).select(F.col("id").alias("k"), F.col("id").alias("m"))
    assert sorted(rows(lookup_join(facts, dim, ["k"]))) == sorted(rows(facts.join(dim, "k")))
    assert rows(lookup_join(facts.limit(0), dim, ["k"])) == []


@pytest.mark.parametrize("name, scans", [("resource_requested_used", 1), ("task_attribute_lookup", 1), ("reconfigured_machine_events", 2)])
def test_the_facts_of_a_lookup_are_read_once(spark, conf, name, scans):
    """One scan of the events, and one of the table that is looked up in."""
    conf(autoBroadcastJoinThreshold="-1")
    t = SampleTrace(spark, FOLDER)
    table = "events" if "machine" in name else "lineitem"
    plan = physical(ANALYSES[name](t))
    assert len(re.findall(rf"FileScan parquet [^\n]*{table}.parquet", plan)) == (scans if "machine" in name else scans + 1)


def uneven_trace(spark):
    """Task events and usage where one task holds a third of the rows."""
    i = F.col("id")
    hot = i % 3 == 0
    task = {"job_id": F.when(hot, 1).otherwise(i % 20_000 + 10), "task_index": F.when(hot, 0).otherwise(i % 3)}
    events = spark.range(600_000, numPartitions=16).select(
        i.alias("time"), *[c.cast("bigint").alias(n) for n, c in task.items()],
        F.when(hot, 3).otherwise(i % 2 + 4).alias("machine_id"), F.lit(1).cast("bigint").alias("event_type"),
        (i % 2).alias("priority"),
        (F.pmod(F.xxhash64("id"), F.lit(64)) / 64 + 0.5).alias("cpu_request"),
        (F.pmod(F.xxhash64("id", i), F.lit(64)) / 64 + 0.5).alias("memory_request"))
    used = spark.range(600_000, numPartitions=16).select(
        F.xxhash64("id").alias("start_time"), *[c.cast("bigint").alias(n) for n, c in task.items()],
        F.lit(0.25).alias("maximum_CPU_rate"), F.lit(0.25).alias("maximum_memory_usage"))
    return events, used


@pytest.mark.parametrize("query", [
    lambda e, u: usage.resource_requested_used(e, u),
    lambda e, u: placement.task_attribute_lookup(e, u),
], ids=["requested_used", "attribute_lookup"])
def test_hot_task_is_spread_over_tasks(spark, split_tasks, query):
    df = query(*uneven_trace(spark))
    assert rows(df.agg(F.count("*"), F.count("cpu_request")))[0] == (600_000, 600_000)
    assert largest_task_share(df) < 0.2


def test_hot_machine_is_joined_after_counting(spark, many_tasks):
    """What reaches the join of a busy machine is one row per priority."""
    events, _ = uneven_trace(spark)
    m = machine_events(spark, *[{"machine_id": i, "cpu": 0.5, "memory": 0.5} for i in (3, 4, 5)])
    df = placement.priority_capacity(events, m)
    assert sorted(rows(df)) == [(0, 0.5, 0.5, 0.5, 300_000), (1, 0.5, 0.5, 0.5, 300_000)]
    below_join = physical(df)[physical(df).index("SortMergeJoin"):]
    assert "partial_count" in below_join.split("Exchange hashpartitioning(machine_id")[2]


def test_distinct_counts_of_a_hot_job_spread_by_task(spark, many_tasks):
    events, _ = uneven_trace(spark)
    plan = physical(tasks.tasks_per_job(events))
    assert re.search(r"Exchange hashpartitioning\(job_id#\d+L?, task_index#\d+L?", plan)


def test_quantiles_of_as_many_values_as_rows(spark, many_tasks):
    """No task gets more than a small part of the distinct values."""
    n = 200_000
    df = spark.range(n, numPartitions=16).select((F.col("id") * 7919 % n * 1_000_003 - 5_000_000).alias("v"))
    low, q1, median, mean, q3, high = rows(six_number_summary(df, "v"))[0]
    value = lambda rank: rank * 1_000_003 - 5_000_000
    assert (low, high) == (value(0), value(n - 1)) and mean == value((n - 1) / 2)
    assert [q1, median, q3] == [value((n - 1) * p) for p in (0.25, 0.5, 0.75)]
    plan = physical(df.groupBy("v").count())
    assert "hashpartitioning(v" in plan and "percentile" not in physical(six_number_summary(df, "v"))


def test_orders_are_counted_once_per_trace(spark, monkeypatch):
    calls = []
    monkeypatch.setattr("tracemill.sources.trace.fits_broadcast", lambda *a: calls.append(a) or True)
    t = SampleTrace(spark, FOLDER)
    for _ in range(3):
        t.tasks("priority")
    assert len(calls) == 1


def test_broadcast_only_below_a_checked_size(spark, conf):
    conf(autoBroadcastJoinThreshold="-1")
    facts = spark.range(1000).select((F.col("id") % 10).alias("k"))
    dim = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("m"))
    assert fits_broadcast(dim, 10 * 64) and not fits_broadcast(dim, 10 * 64 - 1)
    assert not fits_broadcast(dim.withColumn("t", F.col("m").cast("string")))
    small, large = (lookup_join(facts, dim, ["k"], "left", size) for size in (10 * 64, 10 * 64 - 1))
    assert "BroadcastHashJoin" in physical(small) and "BroadcastHashJoin" not in physical(large)
    assert sorted(rows(small)) == sorted(rows(large))


def test_machine_lookup_gives_one_result_either_way(spark, conf):
    conf(autoBroadcastJoinThreshold="-1")
    t = SampleTrace(spark, FOLDER)
    events = t.tasks("time", "job_id", "task_index", "machine_id")
    either = [placement.machine_lookup(events, t.machine_events, size) for size in (1 << 26, 0)]
    assert [("BroadcastHashJoin" in physical(df)) for df in either] == [True, False]
    assert sorted(map(repr, either[0].collect())) == sorted(map(repr, either[1].collect()))


def test_sample_queries_skip_the_orders_join_where_unused(spark):
    t = SampleTrace(spark, FOLDER)
    assert "Join" not in physical(t.tasks("job_id", "machine_id"))
    assert "Join" in physical(t.tasks("job_id", "priority"))
    columns = [c for c in t.task_events.columns if c not in ("user", "priority")]
    assert sorted(map(repr, t.tasks(*columns).collect())) == sorted(map(repr, t.task_events.select(*columns).collect()))


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_results_do_not_depend_on_the_session_time_zone(spark, conf, zone):
    names = ["machines_latest", "daily_task_schedule", "mean_removal_gap"]
    results = lambda: [sorted(rows(ANALYSES[n](SampleTrace(spark, FOLDER)))) for n in names]
    expected = results()
    conf(session__timeZone=zone)
    assert results() == expected


def test_all_survey_queries_are_registered():
    assert len(contract.queries()) >= 90


def test_six_number_summary_of_doubles(spark):
    with pytest.raises(TypeError, match="whole numbers or doubles"):
        six_number_summary(spark.sql("SELECT '1' AS v"), "v")
    assert tuple(six_number_summary(spark.sql("SELECT 1.5D AS v"), "v").first()) == (1.5,) * 6
    assert six_number_summary(spark.sql("SELECT 1.5D AS v"), "v", 0.01).first()["mean"] == 1.5
    rng = np.random.default_rng(3)
    for values in (
        rng.normal(0, 1, 3001), rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-300, 300, 3000), np.repeat([-0.0, 0.0, 5e-324, -1e300], 7),
        np.array([1e308, -3.5, 2.5]), -rng.random(10),
    ):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
        found = tuple(six_number_summary(df, "v").first())
        expected = [values.min(), *np.quantile(values, [0.25, 0.5]), values.mean(), np.quantile(values, 0.75), values.max()]
        assert found == pytest.approx(tuple(map(float, expected)), rel=1e-12)
    infinite = spark.sql("SELECT explode(array(double('-inf'), 1D, 2D, 3D, double('inf'))) AS v")
    assert tuple(six_number_summary(infinite, "v").first())[:3] == (-np.inf, 1.0, 2.0)
    assert tuple(six_number_summary(infinite.limit(0), "v").first()) == (None,) * 6


def test_ordered_bits(spark):
    values = [-np.inf, -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.5, 1e308, np.inf, np.nan]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select(ordered_bits(F.col("v")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert [from_ordered_bits(k) for k in keys[:-1]] == values[:-1]


def as_of(facts, states):
    out = []
    for f in facts:
        known = [s for s in states if None not in (f[0], f[1], s[0], s[1]) and s[0] == f[0] and s[1] <= f[1]]
        last = max(known, key=lambda s: (s[1], s[2], s[3]), default=(None,) * 4)
        out.append((*f, *last[2:]))
    return out


@pytest.mark.parametrize("slot", [1, 7, 50, 10_000])
def test_as_of_join(spark, slot):
    """However long a slot is, each fact meets the last state of its key by then."""
    rng = np.random.default_rng(slot)
    pick = lambda n, k: [None if v < 0 else v for v in rng.integers(-1, k, n).tolist()]
    facts = list(zip(pick(400, 6), pick(400, 300), range(400), strict=True))
    states = list(zip(pick(90, 6), pick(90, 300), rng.integers(0, 3, 90).tolist(), rng.random(90).tolist(), strict=True))
    left = spark.createDataFrame(facts, "k long, t long, n long").repartition(4)
    right = spark.createDataFrame(states, "k long, t long, a long, b double").repartition(3)
    found = as_of_join(left, right, "k", "t", ["a", "b"], slot)
    assert sorted(rows(found), key=repr) == sorted(as_of(facts, states), key=repr)
    inner = as_of_join(left, right, "k", "t", ["a", "b"], slot, "inner")
    assert sorted(rows(inner), key=repr) == sorted([r for r in as_of(facts, states) if r[3] is not None], key=repr)
    assert as_of_join(left, right.limit(0), "k", "t", ["a", "b"], slot).where("a IS NULL").count() == 400


def test_a_hot_key_of_an_as_of_join_is_split(spark, many_tasks):
    """Half of the facts are one machine's, over 40 slots; nothing is joined pair by pair."""
    facts = spark.range(80_000, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 4000).alias("t"), "id")
    states = spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("t"), F.col("id").alias("s"))
    joined = as_of_join(facts, states, "k", "t", ["s"], 100)
    assert largest_task_share(joined) < 0.12
    assert "Nested" not in physical(joined) and "Cartesian" not in physical(joined)
    assert joined.where("k = 1 AND s <> t").count() == 0
