"""The registered queries in DuckDB SQL, written over the sample tables.

``VIEWS`` holds the trace tables and shared results; a query gets those it names, and what they
name in turn, as common table expressions. Latest rows come from window functions here, so the two
sides do not share their way of finding them.
"""

import re

from checks import uneven
from checks.roundtrips import BY_TASK, FIRST_DAY, LAST_DAY, SKETCH_BOUND, STORED_DAYS
from tracemill.functions.columns import DAY

VIEWS = {
    "machine_events": """
        SELECT datediff('microsecond', TIMESTAMP '2024-01-01', ts) AS time,
               user_id AS machine_id,
               CAST(CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'error' THEN 1 ELSE 2 END AS BIGINT)
                 AS event_type,
               'P' || CAST(user_id % 3 AS VARCHAR) AS platform_id,
               CAST(CASE WHEN event_id % 29 = 0 THEN 0.25 WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE)
                 AS cpu,
               CAST(event_id % 4 + 1 AS DOUBLE) / 4 AS memory
        FROM events""",
    "job_events": """
        SELECT datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 86400000000 + o_orderkey AS time,
               o_orderkey % 2 AS missing_info,
               o_orderkey AS job_id,
               CAST(CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN 4
                         WHEN o_orderkey % 5 = 0 THEN 2 ELSE 5 END AS BIGINT) AS event_type,
               CAST(o_custkey AS VARCHAR) AS "user",
               o_orderkey % 4 AS scheduling_class,
               'job-' || CAST(o_orderkey % 1000 AS VARCHAR) AS job_name,
               'logical-' || CAST(o_custkey AS VARCHAR) AS logical_job_name
        FROM orders""",
    "task_events": """
        SELECT datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 86400000000
                 + CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS time,
               CAST(0 AS BIGINT) AS missing_info,
               l_orderkey AS job_id,
               CAST(l_linenumber AS BIGINT) AS task_index,
               CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_suppkey END AS machine_id,
               (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 9 AS event_type,
               CAST(o_custkey AS VARCHAR) AS "user",
               l_orderkey % 4 AS scheduling_class,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority,
               l_quantity / CAST(64 AS DOUBLE) AS cpu_request,
               CAST(l_partkey % 64 AS DOUBLE) / 64 AS memory_request,
               CAST(l_suppkey % 16 AS DOUBLE) / 64 AS disk_space_request,
               l_partkey % 5 = 0 AS different_machine_restrictions
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "task_usage": """
        SELECT datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 86400000000 AS start_time,
               datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 86400000000
                 + CAST(l_quantity * 6000000 AS BIGINT) AS end_time,
               l_orderkey AS job_id,
               CAST(l_linenumber AS BIGINT) AS task_index,
               l_suppkey AS machine_id,
               CAST(l_partkey % 32 AS DOUBLE) / 64 AS cpu_rate,
               CAST(l_suppkey % 32 AS DOUBLE) / 64 AS canonical_memory_usage,
               CAST(l_partkey % 8 AS DOUBLE) / 64 AS assigned_memory_usage,
               CAST(l_linenumber AS DOUBLE) / 64 AS unmapped_page_cache,
               CAST(l_linenumber AS DOUBLE) / 32 AS total_page_cache,
               CAST(l_suppkey % 48 AS DOUBLE) / 64 AS maximum_memory_usage,
               CAST(l_orderkey % 8 AS DOUBLE) / 64 AS disk_io_time,
               CAST(l_suppkey % 8 AS DOUBLE) / 64 AS local_disk_space_usage,
               CAST(l_orderkey % 48 AS DOUBLE) / 64 AS "maximum_CPU_rate",
               CAST(l_orderkey % 4 AS DOUBLE) / 64 AS "maximum_disk_IO_time",
               CAST(l_partkey % 256 AS DOUBLE) / 64 AS cycles_per_instruction,
               CAST(l_suppkey % 128 AS DOUBLE) / 64 AS memory_accesses_per_instruction,
               CAST(1 AS DOUBLE) AS sample_portion,
               l_linenumber % 2 = 1 AS aggregation_type,
               CAST(l_orderkey % 16 AS DOUBLE) / 64 AS "sampled_CPU_usage"
        FROM lineitem""",
    "machines_latest": """
        SELECT time, machine_id, event_type, platform_id, cpu, memory FROM machine_events
        QUALIFY row_number() OVER (PARTITION BY machine_id
          ORDER BY time DESC, event_type DESC, platform_id DESC, cpu DESC, memory DESC) = 1""",
    "removed_for_good": """
        SELECT machine_id, event_type AS last_event, time AS last_event_time
        FROM machines_latest WHERE event_type = 1""",
    "update_configs": """
        SELECT DISTINCT machine_id, platform_id, cpu, memory FROM machine_events WHERE event_type = 2""",
    "update_counts": "SELECT machine_id, count(*) AS update_count FROM update_configs GROUP BY machine_id",
    "add_configs": """
        SELECT DISTINCT machine_id, platform_id, cpu, memory, (cpu + memory) / 2 AS capacity
        FROM machine_events WHERE event_type = 0""",
    "reconfigured": """
        SELECT machine_id, count(*) AS "count" FROM add_configs GROUP BY machine_id HAVING count(*) > 1""",
    "per_job": """
        SELECT job_id, count(*) AS task_count
        FROM (SELECT job_id, task_index FROM task_events GROUP BY job_id, task_index) GROUP BY job_id""",
    "job_totals": """
        SELECT count(*) FILTER (event_type = 1) AS scheduled_job_count,
               count(*) FILTER (event_type = 2) AS evicted_job_count,
               count(*) FILTER (event_type = 5) AS killed_job_count FROM job_events""",
    "task_totals": """
        SELECT count(*) FILTER (event_type = 1) AS scheduled_task_count,
               count(*) FILTER (event_type = 2) AS evicted_task_count,
               count(*) FILTER (event_type = 5) AS killed_task_count FROM task_events""",
    "life_cycle_counts": """
        SELECT priority,
               count(*) FILTER (event_type = 2) AS evicted_task_count,
               count(*) FILTER (event_type = 3) AS failed_task_count,
               count(*) FILTER (event_type = 5) AS killed_task_count,
               count(*) FILTER (event_type = 6) AS lost_task_count,
               count(*) FILTER (event_type = 0) AS submitted_task_count,
               count(*) FILTER (event_type = 1) AS scheduled_task_count,
               count(*) FILTER (event_type = 4) AS finished_task_count,
               count(*) FILTER (event_type = 7) AS update_pending_task_count,
               count(*) FILTER (event_type = 8) AS update_running_task_count
        FROM task_events GROUP BY priority""",
    "life_cycle": """
        SELECT l.*, d.distinct_task_count FROM life_cycle_counts l JOIN (
          SELECT priority, count(*) AS distinct_task_count
          FROM (SELECT DISTINCT priority, job_id, task_index FROM task_events) GROUP BY priority) d
        USING (priority)""",
    "durations": """
        SELECT f.job_id, f.task_index, f.cpu_request, f.memory_request, f.disk_space_request,
               s.start_time, f.time AS end_time,
               CAST(floor((f.time - s.start_time) / 1000000) AS BIGINT) AS elapsed_time
        FROM (SELECT * FROM task_events WHERE event_type = 4
              QUALIFY row_number() OVER (PARTITION BY job_id, task_index ORDER BY time DESC,
                cpu_request DESC, memory_request DESC, disk_space_request DESC) = 1) f
        JOIN (SELECT job_id, task_index, max(time) AS start_time FROM task_events
              WHERE event_type = 1 GROUP BY job_id, task_index) s
        ON f.job_id = s.job_id AND f.task_index = s.task_index""",
    "relation": """
        SELECT t.priority, min(m.cpu) AS cpu, (m.cpu + m.memory) / 2 AS capacity, count(*) AS task_count
        FROM task_events t JOIN machines_latest m ON t.machine_id = m.machine_id
        WHERE t.event_type = 1 GROUP BY t.priority, (m.cpu + m.memory) / 2""",
    "priority_pairs": """
        SELECT DISTINCT t.priority, m.machine_id, m.cpu, m.memory, (m.cpu + m.memory) / 2 AS capacity
        FROM task_events t JOIN machines_latest m ON t.machine_id = m.machine_id WHERE t.event_type = 1""",
    "scheduled_counts": """
        SELECT m.machine_id, CASE WHEN count(t.machine_id) > 0 THEN count(t.machine_id) END AS n
        FROM (SELECT DISTINCT machine_id FROM machine_events) m
        LEFT JOIN task_events t ON t.machine_id = m.machine_id AND t.event_type = 1 GROUP BY m.machine_id""",
    "finished_counts": """
        SELECT m.machine_id, CASE WHEN count(t.machine_id) > 0 THEN count(t.machine_id) END AS n
        FROM (SELECT DISTINCT machine_id FROM machine_events) m
        LEFT JOIN task_events t ON t.machine_id = m.machine_id AND t.event_type = 4 GROUP BY m.machine_id""",
    "max_use": """
        SELECT job_id, task_index, max("maximum_CPU_rate") AS "maximum_CPU_usage",
               max(maximum_memory_usage) AS maximum_memory_usage
        FROM task_usage GROUP BY job_id, task_index""",
    "utilization": """
        SELECT machine_id,
               sum(CAST(end_time - start_time AS DOUBLE) / 1000000 * assigned_memory_usage * "sampled_CPU_usage")
                 AS machine_utilization
        FROM task_usage GROUP BY machine_id""",
    "below_request": """
        SELECT t.job_id, t.task_index, t.cpu_request, t.memory_request,
               u."maximum_CPU_usage", u.maximum_memory_usage,
               round(u."maximum_CPU_usage" * 100 / t.cpu_request, 1) AS used_cpu_percent,
               round(u.maximum_memory_usage * 100 / t.memory_request, 1) AS used_memory_percent
        FROM task_events t JOIN max_use u ON t.job_id = u.job_id AND t.task_index = u.task_index
        WHERE t.cpu_request > u."maximum_CPU_usage" AND t.memory_request > u.maximum_memory_usage""",
    "below_request_per_task": """
        SELECT t.job_id, t.task_index, t.cpu_request, t.memory_request,
               u."maximum_CPU_usage", u.maximum_memory_usage,
               round(u."maximum_CPU_usage" * 100 / t.cpu_request, 1) AS used_cpu_percent,
               round(u.maximum_memory_usage * 100 / t.memory_request, 1) AS used_memory_percent
        FROM (SELECT job_id, task_index, max(cpu_request) AS cpu_request, max(memory_request) AS memory_request
              FROM task_events GROUP BY job_id, task_index) t
        JOIN max_use u ON t.job_id = u.job_id AND t.task_index = u.task_index
        WHERE t.cpu_request > u."maximum_CPU_usage" AND t.memory_request > u.maximum_memory_usage""",
}


def _summary(source: str, column: str) -> str:
    return f"""
        SELECT min({column}) AS "min", quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
               avg({column}) AS mean, quantile_cont({column}, 0.75) AS q3, max({column}) AS "max"
        FROM {source} WHERE {column} IS NOT NULL"""


def _underused(source: str) -> str:
    return f"""
        SELECT count(*) FILTER (coalesce(n, 0) = 0) AS zero_count,
               count(*) FILTER (coalesce(n, 0) < 10) AS below_10_count,
               count(*) FILTER (coalesce(n, 0) < 100) AS below_100_count FROM {source}"""


def _bins(source: str) -> str:
    return f"""
        SELECT CAST(ceil((n - CAST(25 AS DOUBLE)) / 50) * 50 AS BIGINT) AS bin, count(*) AS machine_count
        FROM {source} WHERE n IS NOT NULL GROUP BY 1"""


def _histogram(source: str) -> str:
    def counted(column):
        return f"""(SELECT count(*) FROM {source} WHERE {column} >= b * 5
                    AND ({column} < b * 5 + 5 OR (b = 19 AND {column} = 100)))"""

    return f"""
        SELECT b AS bucket, b * 5 + CAST(2.5 AS DOUBLE) AS midpoint,
               {counted('used_cpu_percent')} AS cpu_count, {counted('used_memory_percent')} AS memory_count
        FROM (SELECT range AS b FROM range(20))"""


def _against_capacity(seconds: int) -> str:
    return f"""
        SELECT u.machine_id, m.cpu, m.memory, u.machine_utilization AS utilization,
               {seconds} * m.cpu * m.memory AS available_capacity_for_29_days
        FROM utilization u LEFT JOIN machines_latest m ON u.machine_id = m.machine_id"""


_ATTRIBUTE_LINES = """
    SELECT concat_ws(',', CAST(datediff('microsecond', TIMESTAMP '2024-01-01', ts) AS VARCHAR),
                     CAST(user_id AS VARCHAR), event_type, props) AS line FROM events"""

# Task events without those whose lines are damaged.
_GOOD_TASKS = {"task_events": "SELECT * FROM base_task_events WHERE time % 97 <> 0 AND time % 89 <> 0"}

_FOLDED_DAYS = f"""
    SELECT * FROM (SELECT * REPLACE (((time % {STORED_DAYS * DAY}) + {STORED_DAYS * DAY}) % {STORED_DAYS * DAY} AS time) FROM base_task_events)
    WHERE time >= {FIRST_DAY * DAY} AND time < {(LAST_DAY + 1) * DAY}"""

QUERIES = {
    # machines
    "machines_latest": "SELECT * FROM machines_latest",
    "machines_latest_capacity":
        "SELECT machine_id, cpu, memory, (cpu + memory) / 2 AS capacity FROM machines_latest",
    "machine_dist_cpu":
        "SELECT cpu AS cpu_capacity, count(*) AS number_of_machines FROM machines_latest GROUP BY cpu",
    "machine_dist_memory":
        "SELECT memory AS memory_capacity, count(*) AS number_of_machines FROM machines_latest GROUP BY memory",
    "machine_dist_platform":
        "SELECT platform_id, count(*) AS number_of_machines FROM machines_latest GROUP BY platform_id",
    "machine_dist_capacity": """
        SELECT cpu, memory, (cpu + memory) / 2 AS capacity, count(*) AS number_of_machines,
               round(count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM machines_latest), 2) AS machine_percentage
        FROM machines_latest GROUP BY cpu, memory""",
    "machine_count": "SELECT count(*) AS machine_count FROM machines_latest",
    "distinct_machines": "SELECT count(DISTINCT machine_id) AS machine_count FROM machine_events",
    "machine_events_ordered": "SELECT * FROM machine_events ORDER BY time",
    "machine_remove_events": "SELECT * FROM machine_events WHERE event_type = 1 ORDER BY time",
    "machine_removals_by_time":
        "SELECT time, machine_id, platform_id, cpu, memory FROM machine_events WHERE event_type = 1",
    "machines_last_event":
        "SELECT machine_id, event_type AS last_event, time AS last_event_time FROM machines_latest",
    "machines_removed_for_good": "SELECT * FROM removed_for_good",
    "removed_for_good_count": "SELECT count(*) AS machine_count FROM removed_for_good",
    "mean_removal_gap": """
        SELECT sum(gap) / (count(gap) * 1000000) AS mean_gap_seconds FROM (
          SELECT time - lag(time) OVER (ORDER BY time) AS gap FROM machine_events WHERE event_type = 1)""",
    "machine_history": "SELECT * FROM machine_events WHERE machine_id = 7",
    "machine_update_configs": "SELECT * FROM update_configs",
    "machine_update_counts": "SELECT * FROM update_counts",
    "top_updated_machines": "SELECT * FROM update_counts ORDER BY update_count DESC, machine_id LIMIT 10",
    "machine_events_by_type": 'SELECT event_type, count(*) AS "count" FROM machine_events GROUP BY event_type',
    "machine_event_type_count": "SELECT count(DISTINCT event_type) AS event_type_count FROM machine_events",
    "machine_first_added":
        "SELECT machine_id, min(time) AS first_time FROM machine_events WHERE event_type = 0 GROUP BY machine_id",
    "add_configurations": "SELECT * FROM add_configs",
    "reconfigured_machines": "SELECT * FROM reconfigured",
    "reconfigured_machine_events": "SELECT e.*, r.count FROM machine_events e JOIN reconfigured r USING (machine_id)",
    **{f"add_dist_{c if c != 'platform_id' else 'platform'}":
       f'SELECT {c}, count(*) AS "count" FROM add_configs GROUP BY {c}'
       for c in ("cpu", "memory", "capacity", "platform_id")},
    "add_machine_total": "SELECT count(*) AS machine_count FROM add_configs",
    # jobs and tasks
    "row_count": "SELECT count(*) AS row_count FROM task_events",
    "tasks_per_job": "SELECT * FROM per_job",
    "job_event_totals": "SELECT * FROM job_totals",
    "task_event_totals": "SELECT * FROM task_totals",
    "event_totals_table": """
        SELECT 'Job' AS type, scheduled_job_count AS scheduled_count, evicted_job_count AS evicted_count,
               killed_job_count AS killed_count FROM job_totals
        UNION ALL SELECT 'Task', scheduled_task_count, evicted_task_count, killed_task_count FROM task_totals""",
    "task_life_cycle": "SELECT * FROM life_cycle",
    "task_life_cycle_joined_ids": """
        SELECT l.*, d.distinct_task_count FROM life_cycle_counts l JOIN (
          SELECT priority,
                 count(DISTINCT CAST(job_id AS VARCHAR) || CAST(task_index AS VARCHAR)) AS distinct_task_count
          FROM task_events GROUP BY priority) d USING (priority)""",
    "task_life_cycle_events": "SELECT * FROM life_cycle_counts",
    "life_cycle_percent": """
        SELECT priority, round(killed_task_count * CAST(100 AS DOUBLE) / distinct_task_count, 1) AS killed_percent,
               round(evicted_task_count * CAST(100 AS DOUBLE) / distinct_task_count, 1) AS evicted_percent,
               round(failed_task_count * CAST(100 AS DOUBLE) / distinct_task_count, 1) AS failed_percent,
               round(lost_task_count * CAST(100 AS DOUBLE) / distinct_task_count, 1) AS lost_percent,
               distinct_task_count AS task_count FROM life_cycle""",
    "job_task_totals": """
        SELECT count(*) AS number_of_jobs, CAST(sum(task_count) AS BIGINT) AS number_of_tasks,
               avg(task_count) AS avg_task_count FROM per_job""",
    "tasks_per_job_summary": _summary("per_job", "task_count"),
    "distinct_jobs": "SELECT count(DISTINCT job_id) AS job_count FROM job_events",
    "daily_task_schedule": """
        SELECT CAST(floor(time / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS day, count(*) AS task_schedule_count
        FROM task_events WHERE event_type = 1 GROUP BY 1""",
    "task_schedule_events": "SELECT * FROM task_events WHERE event_type = 1",
    "task_schedule_pairs": "SELECT machine_id, priority FROM task_events WHERE event_type = 1",
    "task_durations": "SELECT * FROM durations",
    "task_duration_anomalies": "SELECT * FROM durations WHERE end_time < start_time",
    "requested_resources": "SELECT job_id, task_index, cpu_request, memory_request FROM task_events",
    "task_attributes": """
        SELECT job_id, task_index, max(priority) AS priority, max(cpu_request) AS cpu_request,
               max(memory_request) AS memory_request
        FROM task_events WHERE event_type = 1 GROUP BY job_id, task_index""",
    "task_attribute_rows":
        "SELECT DISTINCT job_id, task_index, machine_id, priority, cpu_request, memory_request FROM task_events",
    "task_attribute_row_count": """
        SELECT count(*) AS row_count FROM (
          SELECT DISTINCT job_id, task_index, machine_id, priority, cpu_request, memory_request FROM task_events)""",
    # placement
    "priority_capacity": """
        SELECT priority, cpu, 2 * capacity - cpu AS memory, capacity, task_count FROM relation""",
    "priority_machine_pairs": "SELECT * FROM priority_pairs",
    **{f"priority_{c}_pairs": f'SELECT priority, {c}, count(*) AS "count" FROM priority_pairs GROUP BY priority, {c}'
       for c in ("cpu", "memory", "capacity")},
    "tasks_by_priority":
        "SELECT priority, CAST(sum(task_count) AS BIGINT) AS total_task_count FROM relation GROUP BY priority",
    "priority_capacity_share": """
        SELECT priority, capacity, task_count,
               CAST(sum(task_count) OVER (PARTITION BY priority) AS BIGINT) AS total_task_count,
               round(task_count * CAST(100 AS DOUBLE) / sum(task_count) OVER (PARTITION BY priority), 1)
                 AS task_percentage FROM relation""",
    "task_counts_by_machine":
        "SELECT machine_id, count(*) AS scheduled_task_count FROM task_events WHERE event_type = 1 GROUP BY machine_id",
    "machine_task_counts": "SELECT machine_id, n AS scheduled_task_count FROM scheduled_counts",
    "machine_finished_counts": "SELECT machine_id, n AS finished_task_count FROM finished_counts",
    "underused_machine_counts": _underused("scheduled_counts"),
    "underused_machine_counts_finished": _underused("finished_counts"),
    "tasks_per_machine_histogram": _bins("scheduled_counts"),
    "tasks_per_machine_histogram_finished": _bins("finished_counts"),
    "tasks_per_machine_summary": _summary("scheduled_counts", "n"),
    "tasks_per_machine_summary_finished": _summary("finished_counts", "n"),
    "broadcast_machine_lookup": """
        SELECT t.time, t.job_id, t.task_index, t.machine_id, m.cpu, m.memory
        FROM task_events t LEFT JOIN machines_latest m ON t.machine_id = m.machine_id""",
    "task_attribute_lookup": """
        SELECT u.start_time, u.job_id, u.task_index, t.machine_id, t.priority, t.cpu_request, t.memory_request
        FROM task_usage u LEFT JOIN (
          SELECT * FROM task_events QUALIFY row_number() OVER (PARTITION BY job_id, task_index
            ORDER BY time DESC, machine_id DESC NULLS LAST, priority DESC, cpu_request DESC, memory_request DESC) = 1
        ) t ON u.job_id = t.job_id AND u.task_index = t.task_index""",
    "schedules_as_of": """
        SELECT t.time, t.job_id, t.task_index, t.machine_id, t.priority, a.platform_id, a.cpu, a.memory
        FROM (SELECT * FROM task_events WHERE event_type = 1) t ASOF LEFT JOIN (
          SELECT machine_id, time, platform_id, cpu, memory FROM machine_events WHERE event_type = 0
          QUALIFY row_number() OVER (PARTITION BY machine_id, time ORDER BY platform_id DESC, cpu DESC, memory DESC) = 1
        ) a ON t.machine_id = a.machine_id AND t.time >= a.time""",
    # usage
    "machine_utilization_summary": _summary("utilization", "machine_utilization"),
    "max_resource_use": "SELECT * FROM max_use",
    "task_usage_max": """
        SELECT job_id, task_index, max(maximum_memory_usage) AS maximum_memory_usage,
               max("maximum_CPU_rate") AS "maximum_CPU_rate", max(assigned_memory_usage) AS assigned_memory_usage
        FROM task_usage GROUP BY job_id, task_index""",
    "machine_utilization": "SELECT * FROM utilization",
    "resource_requested_used": "SELECT * FROM below_request",
    "resource_requested_used_per_task": "SELECT * FROM below_request_per_task",
    "consumption_histogram": _histogram("below_request"),
    "consumption_histogram_per_task": _histogram("below_request_per_task"),
    "usage_with_request": """
        SELECT u.*, a.priority, a.cpu_request, a.memory_request FROM (
          SELECT job_id, task_index, max(maximum_memory_usage) AS maximum_memory_usage,
                 max("maximum_CPU_rate") AS "maximum_CPU_rate", max(assigned_memory_usage) AS assigned_memory_usage
          FROM task_usage GROUP BY job_id, task_index) u
        JOIN (SELECT job_id, task_index, max(priority) AS priority, max(cpu_request) AS cpu_request,
                     max(memory_request) AS memory_request
              FROM task_events WHERE event_type = 1 GROUP BY job_id, task_index) a USING (job_id, task_index)""",
    "utilization_vs_capacity": _against_capacity(29 * 60 * 60),
    "utilization_vs_capacity_full_days": _against_capacity(29 * 24 * 60 * 60),
    "unutilized_machine_count": """
        SELECT (SELECT count(*) FROM utilization WHERE machine_utilization = 0) AS zero_utilization_count,
               (SELECT count(*) FROM machines_latest
                WHERE machine_id NOT IN (SELECT machine_id FROM task_usage)) AS absent_count""",
    # readers and writers
    **{f"src_{name}": f"SELECT * FROM {name}" for name in ("machine_events", "job_events", "task_events", "task_usage")},
    "src_raw_lines": _ATTRIBUTE_LINES,
    "attribute_lines": _ATTRIBUTE_LINES,
    "attribute_line_count": "SELECT count(*) AS row_count FROM events",
    "src_raw_line_count": "SELECT count(*) AS row_count FROM events",
    "src_machine_utilization": "SELECT machine_id, machine_utilization AS utilization FROM utilization",
    "src_glob": "SELECT * FROM job_events",
    "parse_defaults": """
        SELECT * REPLACE (
          coalesce(machine_id, 0) AS machine_id,
          CASE WHEN job_id % 5 = 0 THEN 0 ELSE event_type END AS event_type,
          CASE WHEN job_id % 3 = 0 THEN '' ELSE "user" END AS "user",
          CASE WHEN job_id % 4 = 0 THEN 0 ELSE priority END AS priority,
          CASE WHEN job_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE cpu_request END AS cpu_request)
        FROM task_events""",
    "parse_presence_flag": """
        SELECT time, job_id, task_index, job_id % 3 <> 0 AS different_machine_restrictions FROM task_events""",
    "parse_quarantine": """
        SELECT CASE WHEN time % 97 <> 0 THEN time END AS time, machine_id, event_type,
               CASE WHEN NOT cut THEN platform_id END AS platform_id,
               CASE WHEN NOT cut THEN cpu END AS cpu, CASE WHEN NOT cut THEN memory END AS memory,
               CASE WHEN time % 97 = 0
                    THEN 'x' || concat_ws(',', time, machine_id, event_type, platform_id, cpu, memory)
                    WHEN cut THEN concat_ws(',', time, machine_id, event_type) END AS bad_line
        FROM (SELECT *, time % 97 <> 0 AND time % 89 = 0 AS cut FROM machine_events)""",
    "quarantine_bad_lines": """
        SELECT CASE WHEN time % 97 = 0 THEN 'x' || concat_ws(',', time, missing_info, job_id, task_index,
                      coalesce(CAST(machine_id AS VARCHAR), ''), event_type, "user", scheduling_class, priority, cpu_request,
                      memory_request, disk_space_request, CAST(different_machine_restrictions AS INTEGER))
                    ELSE concat_ws(',', time, missing_info, job_id) END AS line
        FROM task_events WHERE time % 97 = 0 OR time % 89 = 0""",
    "sql_event_types": 'SELECT event_type, count(*) AS "count" FROM task_events GROUP BY event_type',
    "parse_lines_roundtrip": "SELECT * FROM job_events",
    "sink_csv_roundtrip": "SELECT * FROM life_cycle",
    "sink_csv_repartition": "SELECT * FROM utilization",
}


def with_views(query: str, views: dict[str, str] = VIEWS) -> str:
    """The query behind the views that it needs, in the order of ``views``."""
    needed, open_texts = set(), [query]
    while open_texts:
        words = set(re.findall(r"\w+", open_texts.pop()))
        for name in (words & views.keys()) - needed:
            needed.add(name)
            open_texts.append(views[name])
    if not needed:
        return query.strip()
    bodies = ",\n".join(f"{name} AS ({body})" for name, body in views.items() if name in needed)
    return f"WITH {bodies}\n{query.strip()}"


def over_other_tables(tables: dict[str, str]) -> dict[str, str]:
    """``VIEWS`` with other tables; those find the plain ones under the names base_<table>."""
    base = {f"base_{name}": VIEWS[name] for name in tables if name in VIEWS}
    return {**base, **tables, **{name: body for name, body in VIEWS.items() if name not in tables}}


def oracle_sql() -> dict[str, str]:
    plain = {name: with_views(query) for name, query in QUERIES.items()}
    views = over_other_tables(uneven.VIEWS)
    others = {f"{name}_uneven": with_views(QUERIES[name], views) for name in uneven.NAMES}
    buckets = {f"bucketed_{name}": with_views(QUERIES[name], views) for name in BY_TASK}
    kept = {
        "ledger_task_events": with_views("SELECT * FROM task_events"),
        "ledger_machines_latest": plain["machines_latest"],
        "clustered_machine_history": plain["machine_history"],
    }
    days = over_other_tables({"task_events": _FOLDED_DAYS})
    stored = {
        "stored_life_cycle_events": with_views(QUERIES["task_life_cycle_events"], days),
        "stored_daily_schedule": with_views(QUERIES["daily_task_schedule"], days),
        "stored_task_counts": with_views("SELECT priority, distinct_task_count, TRUE AS within_bound FROM life_cycle", days),
    }
    good = over_other_tables(_GOOD_TASKS)
    return {**plain, **others, **buckets, **kept, **stored, "quarantine_life_cycle": with_views(QUERIES["task_life_cycle"], good)}
