"""As-of joins: every row beside what was valid at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tracemill.operators.aggregates import latest_by


def as_of_join(
    facts: DataFrame, states: DataFrame, key: str, time: str, values: Sequence[str], slot: int, how: str = "left"
) -> DataFrame:
    """``facts`` with ``values`` of the last row of ``states`` of the same key at the same time or before.

    ``time`` is a whole number in both. Both streams are put in order within slots of ``slot`` time units per key, so a key with very
    many rows is many groups; what a key's state is when a slot starts comes from the last state of each
    slot before it, a table with a row per key and slot. No pair of rows is made, and the facts
    are shuffled once. Of states at one time that with the largest values counts. A null key or
    time meets nothing; with ``how="inner"`` rows that meet nothing go.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    values = list(values)
    at = F.floor(F.col(time) / slot).cast("bigint").alias("_slot")
    known = latest_by(states.where(F.col(key).isNotNull() & F.col(time).isNotNull()), [key, time], values, values)
    marked = known.select(F.col(key), F.col(time), at, F.struct(*values).alias("_state"))
    ends = marked.groupBy(key, "_slot").agg(F.max_by("_state", time).alias("_state"))
    # A row per key and slot with a fact or a state; the state before the slot is the last of those before.
    occupied = facts.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, at).distinct()
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = occupied.withColumn("_state", F.lit(None).cast(ends.schema["_state"].dataType)).unionByName(ends)
    slots = slots.groupBy(key, "_slot").agg(F.max("_state").alias("_state"))
    carried = slots.select(key, "_slot", F.last("_state", ignorenulls=True).over(before).alias("_state")).where("_state IS NOT NULL")

    row = F.struct(*[facts[c] for c in facts.columns]).alias("_row")
    rows = facts.select(F.col(key).alias("_key"), F.col(time).alias("_time"), at, F.lit(2).alias("_kind"), row)
    events = marked.select(F.col(key).alias("_key"), F.col(time).alias("_time"), "_slot", F.lit(1).alias("_kind"), "_state")
    starts = carried.select(F.col(key).alias("_key"), F.lit(None).cast("bigint").alias("_time"), "_slot", F.lit(0).alias("_kind"), "_state")
    # Rows without a key or time meet nothing, so they are spread by their partition.
    lost = F.col("_key").isNull() | F.col("_time").isNull()
    merged = rows.unionByName(events, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    merged = merged.withColumn("_spread", F.when(lost & (F.col("_kind") == 2), F.spark_partition_id()).otherwise(-1))
    so_far = Window.partitionBy("_key", "_slot", "_spread").orderBy(F.asc_nulls_first("_time"), "_kind")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("_found", F.last("_state", ignorenulls=True).over(so_far)).where("_kind = 2")
    if how == "inner":
        found = found.where("_found IS NOT NULL")
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])
