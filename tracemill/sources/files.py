"""Readers for trace files: text lines to typed columns, all in built-in expressions.

One parser serves files and text columns. A bad line fails the job in strict mode, whatever columns
are read, or is kept beside its fields in quarantine mode.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.sources.schemas import MACHINE_UTILIZATION, SPARK_TYPES, Field, Table

SEPARATOR = ","


def read_lines(spark: SparkSession, path: str | list[str], name_glob: str | None = None) -> DataFrame:
    """Raw lines in a column ``line``; path is a file, a folder, a glob or a list of these."""
    reader = spark.read
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.text(path).withColumnRenamed("value", "line")


def read_table(
    spark: SparkSession, table: Table, path: str | list[str], name_glob: str | None = None, **options
) -> DataFrame:
    """A trace table from headerless CSV; the options are those of :func:`parse_lines`."""
    return parse_lines(read_lines(spark, path, name_glob), table, **options)


def read_utilization(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """The written utilization result, read back with its header skipped in every part file."""
    table = MACHINE_UTILIZATION
    return (
        spark.read.schema(table.schema)
        .options(header=header, enforceSchema=True, mode="FAILFAST")
        .csv(path)
        .select(*[F.coalesce(F.col(f.name), F.lit(0.0)).alias(f.name) if f.missing == "zero" else f.name
                  for f in table.fields])
    )


def parse_lines(
    lines: DataFrame,
    table: Table,
    column: str = "line",
    mode: str = "strict",
    presence_flags: bool = False,
    zero_machine_id: bool = False,
) -> DataFrame:
    """Split a text column at the commas (quotes have no meaning) and type the fields.

    Fields past the last column are ignored. A short line, an empty key or a text that is no
    number is bad. "strict" checks every line as a whole and fails the job at a bad one, also if
    only some or no columns are read. "lazy" fails only where a bad field is read, and
    does not parse the others. "quarantine" adds a column ``bad_line`` with the whole text, null for
    good lines, and leaves what cannot be read null.

    ``presence_flags`` makes any non-empty flag true; otherwise '1' is true, other text false and
    an empty field null. ``zero_machine_id`` reads a missing machine as 0 instead of null.
    """
    if mode not in ("strict", "lazy", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    fields = [
        Field(f.name, f.type, "zero") if zero_machine_id and f.missing == "null" and f.type == "long" else f
        for f in table.fields
    ]
    # A generator of one row: a filter above is not moved below it, where the line would be split anew for every field.
    split = lines.select(F.col(column).alias("_line"), F.explode(F.array(F.split(F.col(column), SEPARATOR, -1))).alias("_parts"))
    parts = [F.get("_parts", i) for i in range(len(fields))]
    typed = [_typed(f, p, presence_flags) for f, p in zip(fields, parts)]
    if mode == "lazy":
        return split.select(*[
            _or_fail(table, f, p, v).alias(f.name) for f, p, v in zip(fields, parts, typed)
        ])
    bad = reduce(or_, [_is_bad(f, p, v) for f, p, v in zip(fields, parts, typed)])
    if mode == "strict":
        # A filter stays whatever columns are read above it.
        message = F.concat(F.lit(f"{table.name} cannot be read from: "), F.col("_line"))
        checked = split.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))
        return checked.select(*[_typed(f, p, presence_flags, suffixes=True).alias(f.name) for f, p in zip(fields, parts)])
    return split.select(
        *[v.alias(f.name) for f, v in zip(fields, typed)],
        F.when(bad, F.col("_line")).alias("bad_line"),
    )


def _typed(field: Field, part: Column, presence_flags: bool, suffixes: bool = False) -> Column:
    """The value of a field, null if it cannot be read; with ``suffixes`` Java's type suffixes are taken, or known not to be there."""
    if field.type == "string":
        return part
    if field.type == "flag":
        return part != "" if presence_flags else F.when(part != "", part == "1")
    value = part.try_cast(SPARK_TYPES[field.type])
    if field.type == "double" and not suffixes:
        # The cast also takes Java's type suffixes, as in 1.5d; the f of inf is none. One test: the JVM compiles short code only.
        value = F.when(~part.rlike(r"(?i)(d|(?<!in)f)\s*$"), value)
    if field.missing != "zero":
        return value
    zero = F.lit(0).cast(SPARK_TYPES[field.type])
    return F.when(part == "", zero).otherwise(value)


def _is_bad(field: Field, part: Column, value: Column) -> Column:
    if field.type in ("string", "flag"):
        return part.isNull()
    if field.missing == "null":
        return part.isNull() | ((part != "") & value.isNull())
    return value.isNull()


def _or_fail(table: Table, field: Field, part: Column, value: Column) -> Column:
    message = F.concat(F.lit(f"{table.name}.{field.name} cannot be read from: "), F.col("_line"))
    return F.when(_is_bad(field, part, value), F.raise_error(message)).otherwise(value)


def table_lines(df: DataFrame, table: Table) -> DataFrame:
    """The inverse of :func:`parse_lines`: one text line per row, nulls as empty fields."""
    texts = [
        F.coalesce(F.col(f.name).cast("int").cast("string") if f.type == "flag" else F.col(f.name).cast("string"),
                   F.lit(""))
        for f in table.fields
    ]
    return df.select(F.concat_ws(SEPARATOR, *texts).alias("line"))
