"""The uneven sample tables tell right from wrong: the SQL of a wrong version gives another result."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks import uneven
from checks.oracle import over_other_tables, with_views
from tests.compare import duckdb_over, duckdb_rows

FOLDER = "/root/testdata/sf0.01"
LATEST = 'SELECT DISTINCT machine_id, cpu, memory FROM machine_events'
BELOW = """
    SELECT count(*) AS n FROM (SELECT job_id, task_index, max("maximum_CPU_rate") AS c, max(maximum_memory_usage) AS m
    FROM task_usage GROUP BY ALL) JOIN task_events USING (job_id, task_index) WHERE cpu_request > c AND memory_request > m"""

# Query, and what a wrong version would count; both as one number over the uneven tables.
WRONG = {
    "distinct_jobs": ("SELECT job_count FROM q", "SELECT count(*) FROM job_events"),
    "task_attribute_rows": ("SELECT count(*) FROM q", "SELECT count(*) FROM task_events"),
    "task_attribute_row_count": ("SELECT * FROM q", "SELECT count(*) FROM task_events"),
    "task_life_cycle_joined_ids": ("SELECT sum(distinct_task_count) FROM q", "SELECT count(*) FROM (SELECT DISTINCT priority, job_id, task_index FROM task_events)"),
    "reconfigured_machines": ("SELECT count(*) FROM q", "SELECT count(DISTINCT machine_id) FROM machine_events"),
    "reconfigured_machine_events": ("SELECT count(*) FROM q", "SELECT count(*) FROM machine_events"),
    "utilization_vs_capacity": ("SELECT count(*) FROM q", "SELECT count(*) FROM q WHERE cpu IS NOT NULL"),
    "task_attribute_lookup": ("SELECT count(*) FROM q", "SELECT count(*) FROM q WHERE priority IS NOT NULL"),
    "priority_capacity": ("SELECT sum(task_count) FROM q", "SELECT count(*) FROM task_events WHERE event_type = 1 AND machine_id IS NOT NULL"),
    "unutilized_machine_count": ("SELECT zero_utilization_count FROM q", "SELECT 0"),
    "consumption_histogram": ("SELECT sum(cpu_count) FROM q", f"SELECT n - (SELECT count(*) FROM task_usage WHERE job_id % 19 = 0) FROM ({BELOW})"),
    "machines_latest": ("SELECT sum(memory) FROM q", """SELECT sum(memory) FROM (SELECT memory FROM machine_events
        QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY time DESC, event_type, platform_id, cpu, memory) = 1)"""),
}


@pytest.mark.parametrize("name", sorted(WRONG))
def test_a_wrong_version_differs(name):
    right, wrong = WRONG[name]
    views = {**over_other_tables(uneven.VIEWS)}
    con = duckdb_over(FOLDER)
    con.execute(f"CREATE TABLE q AS {contract.oracle_sql()[f'{name}_uneven']}")
    assert duckdb_rows(con, right)[1] != duckdb_rows(con, with_views(wrong, views))[1]


def test_the_rest_works_without_the_operators_for_training_data():
    """The entry imports, and registers all other queries, where that subpackage is missing."""
    root = Path(__file__).resolve().parents[1]
    code = (
        "import sys; sys.modules['tracemill.llm'] = None; import __spark_entry__ as e; "
        "assert not e.LLM_QUERIES and e.queries().keys() == e.oracle_sql().keys() and len(e.queries()) > 90"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
