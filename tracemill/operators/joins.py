"""Joins of event rows with a table that has one row per key."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F, types as T

BROADCAST_BYTES = 64 * 1024 * 1024
_FIXED_WIDTH = (T.NumericType, T.BooleanType)


def fits_broadcast(dim: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``dim``, counted by a job, stay within ``limit`` bytes in any executor.

    Only columns of fixed width have a known size, so a table with text is refused. A row is taken
    at twice its values plus 32 bytes for the hash table.
    """
    if not all(isinstance(f.dataType, _FIXED_WIDTH) for f in dim.schema.fields):
        return False
    return dim.count() * (16 * len(dim.columns) + 32) <= limit


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    broadcast_bytes: int = 0,
) -> DataFrame:
    """Join ``facts``, where one key may hold a large part of the rows, with ``dim``, one row per key.

    With ``broadcast_bytes``, a dim that fits is sent to the executors and the facts do not move.
    Otherwise both sides are shuffled by the keys and one more column. It is 0, or for facts with a
    null key, which match nothing, the number of their input partition. Since it is a join key,
    both sides reach the join straight from an exchange of its own, whatever they are partitioned
    by before, and no later step relies on the partitioning. That is the shape in which Spark's
    adaptive skew handling splits a partition that one key has made too large.
    """
    keys = list(keys)
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    if broadcast_bytes and fits_broadcast(dim, broadcast_bytes):
        return facts.join(F.broadcast(dim), keys, how)
    spread = "_spread"
    while spread in facts.columns or spread in dim.columns:
        spread += "_"
    no_key = reduce(or_, (F.col(k).isNull() for k in keys))
    # The partition number is the same when a lost task runs again; a random number would not be.
    facts = facts.withColumn(spread, F.when(no_key, F.spark_partition_id()).otherwise(0))
    # A literal on both sides would be folded away, and the exchange with it.
    dim = dim.withColumn(spread, F.explode(F.array(F.lit(0))))
    return facts.join(dim, [*keys, spread], how).drop(spread)
