"""Relations between results that must hold on any trace."""

import pytest
from pyspark.sql import functions as F

from tracemill.plans.catalog import ANALYSES
from tracemill.sources.trace import SampleTrace


@pytest.fixture(scope="module")
def result(spark):
    trace = SampleTrace(spark, "/root/testdata/sf0.001")
    return lambda name: ANALYSES[name](trace)


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_life_cycle_adds_up_to_the_totals(result):
    totals, by_priority = result("task_event_totals").first(), result("task_life_cycle")
    for column in ("scheduled_task_count", "evicted_task_count", "killed_task_count"):
        assert total(by_priority, column) == totals[column]


def test_every_distribution_covers_all_machines(result):
    machines = result("machine_count").first()[0]
    assert machines == result("distinct_machines").first()[0] > 0
    for kind in ("cpu", "memory", "platform", "capacity"):
        assert total(result(f"machine_dist_{kind}"), "number_of_machines") == machines


def test_shares_add_up(result):
    assert abs(total(result("machine_dist_capacity"), "machine_percentage") - 100) < 0.5


def test_scheduled_on_known_machines_is_part_of_scheduled(result):
    assert 0 < total(result("priority_capacity"), "task_count") <= result("task_event_totals").first()[0]


def test_both_histograms_count_the_same_rows(result):
    for suffix, source in (("", "resource_requested_used"), ("_per_task", "resource_requested_used_per_task")):
        histogram = result(f"consumption_histogram{suffix}")
        rows = result(source).count()
        assert total(histogram, "cpu_count") == total(histogram, "memory_count") == rows > 0


def test_tasks_counted_by_priority_and_by_job(result):
    by_priority = total(result("task_life_cycle"), "distinct_task_count")
    by_job = result("job_task_totals").first()["number_of_tasks"]
    assert by_priority >= by_job
    assert total(result("task_life_cycle_joined_ids"), "distinct_task_count") <= by_priority


def test_added_configurations(result):
    machines = result("add_machine_total").first()[0]
    for kind in ("cpu", "memory", "capacity", "platform"):
        assert total(result(f"add_dist_{kind}"), "count") == machines


def test_machines_without_tasks_are_counted(result):
    counts = result("machine_task_counts")
    zero, below_10, below_100 = result("underused_machine_counts").first()
    assert zero == counts.where("scheduled_task_count is null").count() <= below_10 <= below_100 <= counts.count()
