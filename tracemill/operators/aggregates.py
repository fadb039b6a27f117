"""General aggregations over event tables.

All of them aggregate partially before they shuffle, so a key that holds a large part of the rows
reaches its reducer as one row per map task.
"""

import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracemill.functions.columns import SECOND, percent
from tracemill.operators.cache import cached


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that is last by ``order``, with the key and the ``keep`` columns (default: all).

    Equal order values are decided by the kept columns, so the result does not depend on arrival.
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c not in keys]
    state = [*order, *[c for c in keep if c not in order]]
    best = df.groupBy(*keys).agg(F.max(F.struct(*state)).alias("_last"))
    return best.select(*keys, *[F.col("_last")[c].alias(c) for c in keep])


def count_by_code(df: DataFrame, code: str, names: Mapping[str, int], keys: Sequence[str] = (), *more) -> DataFrame:
    """One column per name with the number of rows that carry its code; 0, not null, where there is none."""
    counts = [F.count(F.when(F.col(code) == value, True)).alias(name) for name, value in names.items()]
    return df.groupBy(*keys).agg(*counts, *more)


def count_distinct(df: DataFrame, columns: Sequence[str], name: str, error: float | None = None) -> DataFrame:
    """Number of distinct values; with ``error``, an estimate with that relative deviation."""
    if error is None:
        return df.agg(F.count_distinct(*columns).alias(name))
    value = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return df.agg(F.approx_count_distinct(value, error).alias(name))


def distinct_then_count(df: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """Number of different members per key: first distinct pairs, spread by both columns, then a count."""
    return df.select(key, member).distinct().groupBy(key).agg(F.count("*").alias(name))


def distribution(
    df: DataFrame, columns: Sequence[str], name: str = "count", share: str | None = None, digits: int = 2
) -> DataFrame:
    """Rows per combination of values; with ``share``, also the rounded percentage of all rows."""
    counts = df.groupBy(*columns).agg(F.count("*").alias(name))
    if share is None:
        return counts
    total = counts.agg(F.sum(name)).scalar()
    return counts.withColumn(share, percent(F.col(name), total, digits))


def share_within(df: DataFrame, group: str, value: str, total: str, share: str, digits: int) -> DataFrame:
    """Add the sum of ``value`` over its group and the rounded percentage of that sum.

    The totals come from an aggregate and a join, not from a window, which would sort and keep a
    whole group in one task. Meant for cells that are already aggregated.
    """
    totals = df.groupBy(group).agg(F.sum(value).alias(total))
    return df.join(totals, group).withColumn(share, percent(F.col(value), F.col(total), digits))


def mean_gap(df: DataFrame, time: str, name: str) -> DataFrame:
    """Mean seconds between consecutive times; null below two rows.

    The gaps add up to last minus first, so no ordering of the rows is needed.
    """
    return df.agg(
        F.try_divide(F.max(time) - F.min(time), (F.count(time) - 1) * F.lit(SECOND)).alias(name)
    )


def six_number_summary(df: DataFrame, column: str, error: float | None = None) -> DataFrame:
    """min, q1, median, mean, q3 and max of a column of whole numbers or doubles, nulls left out.

    The quantiles interpolate linearly. They are found by counting (see :func:`_at_ranks`), which
    runs two to eight jobs over the distinct values; no task has to hold them all. Doubles are counted as the whole
    numbers that :func:`ordered_bits` makes of them; NaN is the largest. With ``error``,
    the quantiles are estimates instead, off by at most that share of the ranks, and nothing runs
    until the result is used. Without it, a column of another type is refused.
    """
    q = [0.25, 0.5, 0.75]
    if error is not None:
        stats = df.agg(
            F.min(column).alias("min"),
            F.percentile_approx(column, q, round(1 / error)).cast("array<double>").alias("_q"),
            F.avg(column).alias("mean"),
            F.max(column).alias("max"),
        )
        return stats.select(
            "min", F.get("_q", 0).alias("q1"), F.get("_q", 1).alias("median"), "mean",
            F.get("_q", 2).alias("q3"), "max",
        )
    kind = df.schema[column].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not whole and not isinstance(kind, (T.FloatType, T.DoubleType)):
        raise TypeError(f"{column} is {kind.simpleString()}: exact quantiles need a column of whole numbers or doubles")
    value = F.col(column).cast("bigint" if whole else "double")
    counts = df.where(value.isNotNull()).groupBy(value.alias("_x")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_v", F.col("_x") if whole else ordered_bits(F.col("_x")))
    with cached(counts) as kept:
        low, high, n, total = kept.agg(F.min("_v"), F.max("_v"), F.sum("_n"), F.sum(F.col("_x") * F.col("_n"))).first()
        quartiles: list[float | None] = [None] * 3
        ends: list[float | None] = [None] * 2
        if n:
            places = [(n - 1) * p for p in q]
            at = _at_ranks(kept, low, high, sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places}))
            of = (lambda v: v) if whole else from_ordered_bits
            ends = [of(low), of(high)]
            quartiles = [_between(of(at[int(p)]), of(at[min(int(p) + 1, n - 1)]), p - int(p)) for p in places]
    row = [ends[0], *quartiles[:2], total / n if n else None, quartiles[2], ends[1]]
    kinds = {"min": kind, "q1": "double", "median": "double", "mean": "double", "q3": "double", "max": kind}
    one = df.sparkSession.range(1, numPartitions=1)
    return one.select(*[F.lit(v).cast(k).alias(name) for v, (name, k) in zip(row, kinds.items())])


def _between(a: float, b: float, share: float) -> float:
    """Neither end is weighed by zero: it may be infinite."""
    return a if share == 0 or a == b else a + share * (b - a)


def ordered_bits(value: Column) -> Column:
    """A double as a long in the same order: its bits, those of negative numbers but the sign turned over. NaN is the largest."""
    # Adding zero makes the negative zero positive, which is equal to it.
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def from_ordered_bits(key: int) -> float:
    return struct.unpack("<d", struct.pack("<q", key if key >= 0 else key ^ ((1 << 63) - 1)))[0]


_CELL_BITS = 10


def _at_ranks(counts: DataFrame, low: int, high: int, ranks: Sequence[int]) -> dict[int, int]:
    """The values at ``ranks`` (from 0) of the values ``_v``, each ``_n`` times, all between ``low`` and ``high``.

    Each rank has an interval that its value lies in. One job counts the values of all intervals in about 1,024
    cells, each a run of values with equal leading bits; the cell that holds the rank is its next interval, until
    it is one value.
    """
    intervals = {rank: (low, high, rank) for rank in ranks}  # and the rank inside the interval
    while open_ := sorted({(a, b) for a, b, _ in intervals.values() if b > a}):
        # So many trailing bits are left out that the interval has about as many cells as are wanted.
        shift = {(a, b): max(0, (b - a).bit_length() - _CELL_BITS) for a, b in open_}
        v = F.col("_v")
        cells = [
            F.when(v.between(a, b), F.struct(F.lit(k).alias("k"), F.shiftright(v, shift[a, b]).alias("cell")))
            for k, (a, b) in enumerate(open_)
        ]
        found = counts.select("_n", F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.k", "c.cell")
        sums: dict[int, list[tuple[int, int]]] = {}
        for k, cell, n in found.agg(F.sum("_n")).collect():
            sums.setdefault(k, []).append((cell, n))
        for rank, (a, b, inside) in intervals.items():
            if b == a:
                continue
            for cell, n in sorted(sums[open_.index((a, b))]):
                if inside < n:
                    start, bits = cell << shift[a, b], shift[a, b]
                    intervals[rank] = (max(a, start), min(b, start + (1 << bits) - 1), inside)
                    break
                inside -= n
    return {rank: a for rank, (a, _, _) in intervals.items()}


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))
