"""General operators against plain Python on random rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.tables import rows
from tracemill.functions import bucket_of
from tracemill.operators import (
    count_by_code, count_distinct, distinct_then_count, distribution, latest_by, lookup_join, mean_gap, share_within,
    six_number_summary,
)

COLUMNS = "k bigint, t bigint, code bigint, v double"


@pytest.fixture(scope="module")
def data():
    """Many ties, null keys and null values."""
    rng = random.Random(11)
    return [
        (rng.choice([None, *range(9)]), rng.randrange(6), rng.randrange(4), rng.choice([None, 0.0, 2.5, 5.0, 9.9, 10.0, 11.0]))
        for _ in range(700)
    ]


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, COLUMNS).repartition(7)


def nulls_first(row):
    return tuple((x is not None, x) if x is not None else (False, 0) for x in row)


def by_key(data):
    groups = {}
    for row in data:
        groups.setdefault(row[0], []).append(row)
    return groups


def test_latest_by(df, data):
    expected = [max(group, key=nulls_first) for group in by_key(data).values()]
    assert sorted(rows(latest_by(df, ["k"], ["t"])), key=nulls_first) == sorted(expected, key=nulls_first)


def test_counts(df, data):
    groups = by_key(data)
    got = {r[0]: r[1:] for r in rows(count_by_code(df, "code", {"a": 0, "b": 3, "c": 8}, ["k"]))}
    assert got == {k: tuple(sum(r[2] == c for r in g) for c in (0, 3, 8)) for k, g in groups.items()}
    assert dict(rows(distribution(df, ["k"]))) == {k: len(g) for k, g in groups.items()}
    assert dict(rows(distinct_then_count(df, "k", "t", "n"))) == {k: len({r[1] for r in g}) for k, g in groups.items()}
    pairs = {(r[0], r[1]) for r in data if r[0] is not None}
    assert rows(count_distinct(df, ["k", "t"], "n")) == [(len(pairs),)]


def test_shares(df, data):
    got = {r[0]: r[2] for r in rows(distribution(df, ["code"], "n", "percent", 2))}
    assert got == {c: pytest.approx(100 * sum(r[2] == c for r in data) / len(data), abs=0.0051) for c in range(4)}
    cells = distribution(df.where("k is not null"), ["k", "code"], "n")
    for k, code, n, total, percent in rows(share_within(cells, "k", "n", "total", "percent", 1).select("k", "code", "n", "total", "percent")):
        assert total == sum(r[0] == k for r in data)
        assert percent == pytest.approx(100 * n / total, abs=0.051)


def test_summary(df, data):
    values = [r[0] for r in data if r[0] is not None]
    expected = [min(values), *np.percentile(values, [25, 50]), np.mean(values), np.percentile(values, 75), max(values)]
    assert rows(six_number_summary(df, "k"))[0] == pytest.approx(tuple(float(x) for x in expected))


def test_buckets(df, data):
    edges = [0, 2.5, 5, 10]

    def bucket(v):
        if v is None or not edges[0] <= v <= edges[-1]:
            return None
        return int(np.histogram([v], edges)[0].argmax())

    got = dict(rows(df.select("v", bucket_of(F.col("v"), edges)).distinct()))
    assert got == {v: bucket(v) for v in {r[3] for r in data}}


def test_mean_gap(df, data):
    times = sorted(r[1] for r in data)
    assert rows(mean_gap(df, "t", "gap"))[0][0] == pytest.approx(np.diff(times).mean() / 1e6)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join(spark, df, data, how):
    dim = spark.createDataFrame([(k, k * 10) for k in range(5)], "k bigint, m bigint")
    expected = [(*r, r[0] * 10 if r[0] is not None and r[0] < 5 else None) for r in data]
    if how == "inner":
        expected = [r for r in expected if r[-1] is not None]
    for limit in (0, 1 << 20):
        got = rows(lookup_join(df, dim, ["k"], how, limit))
        assert sorted(got, key=nulls_first) == sorted(expected, key=nulls_first)
