"""Hash mixing against DuckDB, and its promises."""

from collections import defaultdict

import pytest

from tests.compare import duckdb_over, duckdb_rows, spark_rows
from tests.llm.fixtures import FOLDER, SMALL, documents, odd_documents
from tracemill.llm import mixing
from tracemill.llm.queries import ORACLE_SQL, op10_hash_mix


@pytest.mark.parametrize("folder", [SMALL, FOLDER])
def test_equals_duckdb(spark, folder):
    columns, found = spark_rows(op10_hash_mix(spark, folder))
    assert (columns, found) == duckdb_rows(duckdb_over(folder), ORACLE_SQL["op10_hash_mix"])


def filled(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = budget - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_promises(spark):
    table = [(i, "w " * (1 + i * 7 % 23), None, f"s{min(i % 9, 4)}" if i % 11 else None, None) for i in range(600)]
    table += [(1000, "", None, "empty", None), (1001, None, None, "empty", None), (1002, "big " * 4000, None, "\U0001f600", None)]
    docs = documents(spark, table)
    found = mixing.mix(docs).collect()
    source = {r[0]: r[3] for r in table}
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in found:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert target == pytest.approx(filled(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    copies = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] * len((dict((t[0], t[1]) for t in table)[r.doc_id] or "").split()) for r in copies if source[r.doc_id] != "empty"} == {
        r.doc_id: r.taken for r in found if r.taken
    }


def test_thresholds_are_nested(spark):
    """A larger budget takes what a smaller one takes, and more."""
    docs = documents(spark, [(i, "w " * (1 + i % 13), None, "one", None) for i in range(300)] + [(1000, "w " * 9000, None, "two", None)])
    less = {r.doc_id for r in mixing.mix(docs.where("doc_id < 300")).where("taken > size").collect()}
    more = {r.doc_id for r in mixing.mix(docs).where("taken > size").collect()}
    assert less and less <= more


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    assert sum(r.size == 0 and r.taken == 0 for r in found) == 4
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def test_documents_without_an_id_have_places_of_their_own(spark):
    """Null ids and one repeated id: each source is off by at most half of a document."""
    table = [(None, f"text {i} " + "w " * 51, None, "none", None) for i in range(400)] + [(7, f"seven {i} " + "w " * 38, None, "one", None) for i in range(300)]
    found = mixing.mix(documents(spark, table + [(1000, "big " * 9000, None, "zz", None)])).collect()
    for source_size, size in ((400 * 53, 53), (300 * 40, 40)):
        mine = [r for r in found if r.source_size == source_size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= size / 2


def test_repeated_rows_are_taken_alike(spark):
    table = [(i // 3, f"text {i // 3}", None, "one", None) for i in range(300)] + [(1000, "big " * 9000, None, "two", None)]
    found = {}
    for r in mixing.mix(documents(spark, table)).collect():
        found.setdefault(r.doc_id, set()).add(r.taken)
    assert all(len(taken) == 1 for taken in found.values()) and len({t for x in found.values() for t in x}) > 1


def test_many_sources(spark):
    """Running sums over ranges of sources give the targets of one list."""
    rng = __import__("random").Random(5)
    sizes = {f"s{i:04}": rng.randrange(0, 400) for i in range(700)} | {None: 55}
    rows = [(("n" if s is None else "s" + s), s, n) for s, n in sizes.items()]
    found = mixing.targets(spark.createDataFrame(rows, "key string, source string, source_size long").repartition(6))
    assert {r.key: r.target for r in found.collect()} == pytest.approx({("n" if s is None else "s" + s): t for s, t in filled(sizes).items()})
