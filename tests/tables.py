"""Small trace tables from literal rows; columns that a test does not name get a neutral value."""

from tracemill.sources.schemas import JOB_EVENTS, MACHINE_EVENTS, TASK_EVENTS, TASK_USAGE

NEUTRAL = {"long": 0, "double": 0.0, "string": "", "flag": None}


def _table(spark, table, rows):
    full = [tuple(row.get(f.name, NEUTRAL[f.type]) for f in table.fields) for row in rows]
    return spark.createDataFrame(full, table.schema)


def machine_events(spark, *rows):
    return _table(spark, MACHINE_EVENTS, rows)


def job_events(spark, *rows):
    return _table(spark, JOB_EVENTS, rows)


def task_events(spark, *rows):
    return _table(spark, TASK_EVENTS, rows)


def task_usage(spark, *rows):
    return _table(spark, TASK_USAGE, rows)


def rows(df):
    return [tuple(r) for r in df.collect()]
