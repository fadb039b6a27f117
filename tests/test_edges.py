"""Hand-made rows for what the sample tables do not exercise, or only by chance."""

import math

from pyspark.sql import functions as F

from tests.tables import job_events, machine_events, rows, task_events, task_usage
from tracemill.operators import bucket_histogram, mean_gap, six_number_summary
from tracemill.plans import machines, placement, report, tasks, usage


def test_task_ids_that_join_to_one_text(spark):
    t = task_events(spark, {"job_id": 1, "task_index": 23}, {"job_id": 12, "task_index": 3})
    count = lambda how: tasks.task_life_cycle(t, how).select("distinct_task_count").collect()[0][0]
    assert [count("exact"), count("joined"), count("estimated")] == [2, 1, 2]


def test_histogram_edges(spark):
    values = [0.0, 5.0, 99.9, 100.0, 100.1, -1.0, None, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = rows(bucket_histogram(df, {"n": "v"}, list(range(0, 101, 5))))
    assert [(b, n) for b, _, n in counts if n] == [(0, 1), (1, 1), (19, 2)]
    assert [b for b, _, _ in counts] == list(range(20))
    assert [m for _, m, _ in counts][:2] == [2.5, 7.5]


def test_histogram_with_uneven_edges(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (1.0,), (7.0,)], "v double")
    assert [n for *_, n in rows(bucket_histogram(df, {"n": "v"}, [0, 0.3, 1, 10]))] == [1, 1, 2]


def test_zero_requests_are_no_under_use_and_no_error(spark):
    t = task_events(spark, {"job_id": 1, "task_index": 1})
    u = task_usage(spark, {"job_id": 1, "task_index": 1})
    assert rows(usage.resource_requested_used(t, u)) == []
    assert rows(usage.resource_requested_used(t, u, "task")) == []


def test_under_use_per_event_and_per_task(spark):
    t = task_events(
        spark,
        {"job_id": 1, "task_index": 1, "cpu_request": 0.5, "memory_request": 0.5},
        {"job_id": 1, "task_index": 1, "cpu_request": 0.5, "memory_request": 0.5},
        {"job_id": 1, "task_index": 1, "cpu_request": 0.25, "memory_request": 1.0},
    )
    u = task_usage(
        spark,
        {"job_id": 1, "task_index": 1, "maximum_CPU_rate": 0.25, "maximum_memory_usage": 0.1},
        {"job_id": 1, "task_index": 1, "maximum_CPU_rate": 0.125, "maximum_memory_usage": 0.25},
    )
    assert rows(usage.resource_requested_used(t, u)) == [(1, 1, 0.5, 0.5, 0.25, 0.25, 50.0, 50.0)] * 2
    assert rows(usage.resource_requested_used(t, u, "task")) == [(1, 1, 0.5, 1.0, 0.25, 0.25, 50.0, 25.0)]


def test_one_capacity_from_two_kinds_of_machine(spark):
    m = machine_events(spark, {"machine_id": 1, "cpu": 1.0, "memory": 0.5}, {"machine_id": 2, "cpu": 0.5, "memory": 1.0})
    t = task_events(spark, *[{"machine_id": i, "event_type": 1, "priority": 3} for i in (1, 1, 2)])
    assert rows(placement.priority_capacity(t, m)) == [(3, 0.5, 1.0, 0.75, 3)]


def test_tie_on_time(spark):
    m = machine_events(spark, {"time": 5, "machine_id": 1, "event_type": 2, "cpu": 0.5},
                       {"time": 5, "machine_id": 1, "event_type": 1, "cpu": 1.0})
    assert rows(machines.machines_latest(m)) == [(5, 1, 2, "", 0.5, 0.0)]
    assert rows(machines.machines_removed_for_good(m)) == []


def test_schedule_on_an_unknown_machine(spark):
    m = machine_events(spark, {"machine_id": 1, "cpu": 0.5, "memory": 0.5})
    t = task_events(spark, {"machine_id": 9, "event_type": 1}, {"machine_id": None, "event_type": 1})
    assert rows(placement.priority_capacity(t, m)) == []
    assert rows(placement.machine_task_counts(m, t)) == [(1, None)]
    assert rows(placement.machine_lookup(t, m).select("machine_id", "cpu").orderBy("machine_id")) == [(None, None), (9, None)]


def test_machine_without_an_id_is_not_machine_zero(spark):
    m = machine_events(spark, {"machine_id": 0, "cpu": 0.5, "memory": 0.5})
    t = task_events(spark, {"machine_id": None, "event_type": 1})
    assert rows(placement.machine_task_counts(m, t)) == [(0, None)]


def test_empty_tables(spark):
    m, j, t, u = machine_events(spark), job_events(spark), task_events(spark), task_usage(spark)
    assert rows(tasks.job_event_totals(j)) == [(0, 0, 0)]
    assert rows(tasks.task_event_totals(t)) == [(0, 0, 0)]
    assert rows(tasks.distinct_jobs(j)) == [(0,)]
    assert rows(machines.add_machine_total(m)) == [(0,)]
    assert rows(machines.machine_dist_capacity(machines.machines_latest(m))) == []
    assert rows(report.job_task_totals(tasks.tasks_per_job(t))) == [(0, 0, None)]
    assert rows(report.tasks_per_job_summary(tasks.tasks_per_job(t))) == [(None,) * 6]
    assert rows(report.mean_removal_gap(m)) == [(None,)]
    histogram = usage.consumption_histogram(t, u)
    assert rows(histogram.agg(F.sum("cpu_count"), F.sum("memory_count"))) == [(0, 0)]


def test_single_removal_has_no_gap(spark):
    m = machine_events(spark, {"time": 5, "machine_id": 1, "event_type": 1})
    assert rows(report.mean_removal_gap(m)) == [(None,)]


def test_gap_between_removals_in_any_order(spark):
    df = spark.createDataFrame([(9_000_000,), (1_000_000,), (4_000_000,)], "time bigint")
    assert rows(mean_gap(df, "time", "gap")) == [(4.0,)]


def test_duration_takes_last_schedule_last_finish_and_its_requests(spark):
    event = lambda time, kind, cpu=0.0: {
        "time": time, "job_id": 1, "task_index": 1, "event_type": kind, "cpu_request": cpu}
    t = task_events(spark, event(1, 1), event(2_000_001, 1), event(3, 4, 0.1), event(5_000_000, 4, 0.2), event(9, 5))
    assert rows(tasks.task_durations(t)) == [(1, 1, 0.2, 0.0, 0.0, 2_000_001, 5_000_000, 2)]
    assert rows(tasks.task_duration_anomalies(t)) == []
    backwards = task_events(spark, event(3_500_000, 1), event(1_000_000, 4))
    assert [r[-1] for r in rows(tasks.task_duration_anomalies(backwards))] == [-3]
    assert rows(tasks.task_durations(task_events(spark, event(1, 1)))) == []


def test_summary_interpolates(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 10, None)], "n bigint")
    assert rows(six_number_summary(df, "n")) == [(1, 1.75, 2.0, 3.75, 4.0, 10)]
    estimated = rows(six_number_summary(df, "n", error=0.01))[0]
    assert (estimated[0], estimated[3], estimated[5]) == (1, 3.75, 10)


def test_estimated_distinct_jobs(spark):
    j = job_events(spark, *[{"job_id": i % 50} for i in range(200)])
    assert abs(rows(tasks.distinct_jobs(j, error=0.01))[0][0] - 50) <= 1


def test_underused_counts_take_missing_as_none(spark):
    df = spark.createDataFrame([(1, None), (2, 9), (3, 10), (4, 99), (5, 100)], "machine_id bigint, scheduled_task_count bigint")
    assert rows(report.underused_machine_counts(df)) == [(1, 2, 4)]


def test_histogram_bins_are_centred_and_closed_on_the_right(spark):
    df = spark.createDataFrame([(n,) for n in (1, 25, 26, 75, 76, None)], "scheduled_task_count bigint")
    assert rows(report.tasks_per_machine_histogram(df)) == [(0, 2), (50, 2), (100, 1)]


def test_utilization_of_zero_and_absence(spark):
    u = task_usage(
        spark,
        {"machine_id": 1, "end_time": 2_000_000, "assigned_memory_usage": 0.5, "sampled_CPU_usage": 0.5},
        {"machine_id": 1, "end_time": 1_000_000, "assigned_memory_usage": 0.5, "sampled_CPU_usage": 1.0},
        {"machine_id": 2, "end_time": 1_000_000},
    )
    m = machine_events(spark, *[{"machine_id": i, "cpu": 0.5, "memory": 0.5} for i in (1, 2, 3)])
    utilization = usage.machine_utilization(u)
    assert sorted(rows(utilization)) == [(1, 1.0), (2, 0.0)]
    assert rows(report.unutilized_machine_count(utilization, machines.machines_latest(m))) == [(1, 1)]
    beside = usage.utilization_vs_capacity(
        utilization.withColumnRenamed("machine_utilization", "utilization"), machines.machines_latest(m))
    assert rows(beside) == [(2, 0.5, 0.5, 0.0, 26100.0), (1, 0.5, 0.5, 1.0, 26100.0)]


def test_machine_history_takes_large_ids(spark):
    big = 3_349_480_405
    m = machine_events(spark, {"time": 2, "machine_id": big}, {"time": 1, "machine_id": big}, {"machine_id": 4})
    assert [r[0] for r in rows(machines.machine_history(m, big))] == [1, 2]


def test_latest_attributes_of_a_task(spark):
    t = task_events(spark, {"time": 1, "job_id": 1, "machine_id": 5, "priority": 1},
                    {"time": 2, "job_id": 1, "machine_id": 6, "priority": 2})
    u = task_usage(spark, {"job_id": 1, "start_time": 7}, {"job_id": 2, "start_time": 8})
    assert sorted(rows(placement.task_attribute_lookup(t, u))) == [
        (7, 1, 0, 6, 2, 0.0, 0.0), (8, 2, 0, None, None, None, None)]
    assert sorted(rows(tasks.task_attribute_rows(t))) == [(1, 0, 5, 1, 0.0, 0.0), (1, 0, 6, 2, 0.0, 0.0)]
