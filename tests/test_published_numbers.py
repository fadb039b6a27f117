"""Arithmetic over published results of a 12,583-machine trace, given here as plain numbers."""

from tests.tables import rows
from tracemill.operators import distribution
from tracemill.plans import report

# Fixed values: (cpu, memory, machines, percent of machines).
KINDS = [
    (1.0, 1.0, 795, 6.32), (1.0, 0.5, 3, 0.02), (0.5, 0.9678, 5, 0.04), (0.5, 0.749, 1001, 7.96),
    (0.5, 0.4995, 6732, 53.5), (0.5, 0.2493, 3863, 30.7), (0.5, 0.1241, 52, 0.41), (0.5, 0.06158, 1, 0.01),
    (0.5, 0.03085, 5, 0.04), (0.25, 0.2498, 126, 1.0),
]
# Priority, then evicted, failed, killed, lost and distinct tasks.
LIFE_CYCLES = [
    (11, 0, 0, 1927, 0, 7538), (10, 503, 21422, 9383, 1, 1403), (9, 16825, 1309946, 227918, 102, 286269),
    (5, 0, 0, 0, 0, 104), (0, 5290793, 11036256, 5386416, 4066, 6472128),
]
# Priority, capacity and scheduled tasks of two priorities.
CELLS = [
    (5, 0.49975, 70), (5, 0.37465, 32), (5, 1.0, 2),
    (7, 0.2499, 1), (7, 0.37465, 20), (7, 0.49975, 470), (7, 0.6245, 222), (7, 1.0, 82), (7, 0.7339, 1),
]


def test_percent_of_machines(spark):
    machines = spark.createDataFrame(
        [(cpu, memory) for cpu, memory, n, _ in KINDS for _ in range(n)], "cpu double, memory double")
    shares = distribution(machines, ["cpu", "memory"], "machines", "percent", 2)
    assert sorted(rows(shares)) == sorted(KINDS)
    by_cpu = rows(distribution(machines, ["cpu"], "machines").orderBy("cpu"))
    assert by_cpu == [(0.25, 126), (0.5, 11659), (1.0, 798)]


def test_events_per_hundred_tasks(spark):
    columns = "priority bigint, evicted_task_count bigint, failed_task_count bigint, killed_task_count bigint, " \
              "lost_task_count bigint, distinct_task_count bigint"
    result = rows(report.life_cycle_percent(spark.createDataFrame(LIFE_CYCLES, columns)))
    assert result == [
        (11, 25.6, 0.0, 0.0, 0.0, 7538),
        (10, 668.8, 35.9, 1526.9, 0.1, 1403),
        (9, 79.6, 5.9, 457.6, 0.0, 286269),
        (5, 0.0, 0.0, 0.0, 0.0, 104),
        (0, 83.2, 81.7, 170.5, 0.1, 6472128),
    ]


def test_heat_map_cells(spark):
    cells = spark.createDataFrame(CELLS, "priority bigint, capacity double, task_count bigint")
    assert rows(report.tasks_by_priority(cells)) == [(5, 104), (7, 796)]
    shares = {(p, c): s for p, c, _, _, s in rows(report.priority_capacity_share(cells))}
    assert shares[5, 0.49975] == 67.3 and shares[7, 0.49975] == 59.0 and shares[7, 0.7339] == 0.1
