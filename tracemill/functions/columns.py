"""Column expressions shared by the analyses. Trace times are whole microseconds."""

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
DAY = 24 * 60 * 60 * SECOND


def capacity(cpu: str = "cpu", memory: str = "memory") -> Column:
    """Mean of the two capacities of a machine."""
    return (F.col(cpu) + F.col(memory)) / 2


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Rounded share of ``whole``; null where ``whole`` is zero."""
    return F.round(F.try_divide(part * 100, whole), digits)


def whole_days(time: str = "time") -> Column:
    return F.floor(F.col(time) / DAY)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, rounded down."""
    return F.floor((end - start) / SECOND)


def joined_ids(*names: str) -> Column:
    """The ids written one after another without a separator: (1, 23) and (12, 3) give the same text."""
    return F.concat(*[F.col(n).cast("string") for n in names])


def bucket_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the bucket between two edges: closed on the left, the last one on both sides.

    Null for values outside the edges, nulls and NaN. Plain comparisons keep values that lie on
    an edge exact for any step.
    """
    passed = [(value >= F.lit(float(e))).cast("bigint") for e in edges[1:-1]]
    inside = (value >= F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1]))) & ~F.isnan(value)
    return F.when(inside, reduce(add, passed, F.lit(0).cast("bigint")))


def centred_bin(value: Column, width: int) -> Column:
    """Centre of the bin of a whole number: bins centred on multiples of ``width``, closed on the right."""
    return (F.ceil((value - width / 2) / width) * width).cast("bigint")
