"""Totals merged from stored days against the same analyses over all rows."""

from tests.tables import rows, task_events
from tracemill.plans import partials, tasks
from tracemill.session import scratch_folder

DAY = 86_400_000_000


def events(spark):
    """Five days; a task comes again on later days, one job holds a third of the rows, one day has no schedule."""
    return task_events(spark, *[
        {"time": (i % 5) * DAY + i, "job_id": 1 if i % 3 == 0 else i % 40, "task_index": i % 7, "priority": i % 4,
         "event_type": 0 if i % 5 == 2 else i % 9} for i in range(3000)
    ])


def test_ranges_equal_the_direct_results(spark):
    table, folder = events(spark), scratch_folder(spark, "days")
    partials.store_days(table, folder)
    for first, last in ((None, None), (1, 3), (2, 2), (9, 9)):
        part = table.where(f"time >= {(first or 0) * DAY} AND time < {(99 if last is None else last + 1) * DAY}")
        states = partials.stored_days(spark, folder, first, last)
        assert rows(partials.merged_life_cycle_events(states)) == rows(tasks.task_life_cycle_events(part))
        assert rows(partials.merged_daily_schedule(states)) == rows(tasks.daily_task_schedule(part))
        exact = {r.priority: r.distinct_task_count for r in tasks.task_life_cycle(part).collect()}
        found = dict(rows(partials.merged_task_counts(states)))
        assert found.keys() == exact.keys() and all(abs(found[p] - n) <= 0.03 * n for p, n in exact.items())


def test_a_day_is_replaced_whole_and_others_stay(spark):
    table, folder = events(spark), scratch_folder(spark, "days")
    partials.store_days(table.where(f"time < {4 * DAY}"), folder)
    partials.store_days(table.where(f"time >= {4 * DAY}"), folder)
    partials.store_days(table.where(f"time >= {4 * DAY}"), folder)  # once more, after a broken run
    assert rows(partials.merged_life_cycle_events(partials.stored_days(spark, folder))) == rows(tasks.task_life_cycle_events(table))
