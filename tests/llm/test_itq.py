"""Near-duplicate vectors against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import duckdb_over, duckdb_rows, spark_rows
from tests.llm.fixtures import FOLDER
from tracemill.llm import itq
from tracemill.llm.queries import ORACLE_SQL, op4_itq_near_dup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(table, least=0.93):
    """Links and components by all pairs, in double precision, of vectors that may link."""
    good = [
        i for i, (_, v, label) in enumerate(table)
        if label is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(np.float32(x) != 0 for x in v)
    ]
    unit = {i: np.array(np.float32(table[i][1]), np.float64) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: [j for j in good if j != i and table[i][2] == table[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in good}
    out = []
    for i, (vec_id, *_) in enumerate(table):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links.get(todo.pop(), []) if j not in seen]
            seen.update(new)
            todo += new
        component = min((table[j][0] for j in seen if table[j][0] is not None), default=None)
        out.append((vec_id, len(links.get(i, [])), component, vec_id == component))
    return sorted(out, key=repr)


def clusters(seed, groups, members, dimensions=32, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dimensions))
    out = [(centres[g] + noise * rng.normal(size=dimensions), g % 3) for g in range(groups) for _ in range(members(g))]
    order = rng.permutation(len(out))
    return [(int(k), [float(x) for x in np.float32(out[i][0])], out[i][1]) for k, i in enumerate(order)]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [itq.BLOCK, 16])
def test_groups_of_many_sizes(spark, monkeypatch, block):
    """With small blocks the large group is dealt into pairs of parts: the links are the same."""
    monkeypatch.setattr(itq, "BLOCK", block)
    table = clusters(1, 60, lambda g: 90 if g == 0 else g % 4)
    table += [(1000 + i, table[0][1], table[0][2]) for i in range(50)]  # one vector with many copies
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    assert found(itq.near_duplicates(df)) == brute(table)


def test_recall_near_the_threshold(spark):
    """Pairs whose cosine is just above the threshold: nine of ten are found at least, and none below it."""
    rng = np.random.default_rng(7)
    table = []
    for k in range(400):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = rng.uniform(0.90, 0.96)
        table += [(2 * k, (3 * a).tolist(), 1), (2 * k + 1, (cosine * a + np.sqrt(1 - cosine**2) * b).tolist(), 1)]
    expected = {r[0] for r in brute(table) if r[1]}
    linked = {r[0] for r in found(itq.near_duplicates(spark.createDataFrame(table, SCHEMA))) if r[1]}
    assert linked <= expected and len(linked) >= 0.9 * len(expected) > 200


@pytest.mark.parametrize(("dimensions", "common"), [(128, 0), (256, 0), (768, 0), (64, 0.7), (384, 0.5)])
def test_recall_in_many_dimensions_and_with_a_common_mean(spark, monkeypatch, dimensions, common):
    """Pairs just above the threshold among vectors that share a direction (squared part ``common``)."""
    monkeypatch.setattr(itq, "ROUNDS", 3)
    monkeypatch.setattr(itq, "BUCKET", 4)
    monkeypatch.setattr(itq, "BLOCK", 8)  # so that parts of several bits are worth while
    rng = np.random.default_rng(3)
    mean = np.eye(1, dimensions)[0] * np.sqrt(common)
    a = mean + rng.normal(size=(300, dimensions)) * np.sqrt((1 - common) / dimensions)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    table = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, 0.931 * a + np.sqrt(1 - 0.931**2) * b]))]
    expected = {r[0] for r in brute(table) if r[1]}
    linked = {r[0] for r in found(itq.near_duplicates(spark.createDataFrame(table, SCHEMA))) if r[1]}
    assert linked <= expected and len(linked) >= 0.9 * len(expected) >= 0.9 * 600


def test_tables_for_many_vectors():
    """For many vectors parts have many bits, and pairs that nothing was learnt from still meet."""
    rng = np.random.default_rng(4)
    for dimensions, common in ((64, 0.7), (64, 0.9), (256, 0)):
        draw = lambda n: itq._unit(rng.normal(size=(n, dimensions)) * np.sqrt((1 - common) / dimensions) + np.eye(1, dimensions)[0] * np.sqrt(common))  # noqa: E731, B023
        tables = itq.choose_tables(draw(2000), dimensions, 1_000_000, 0.93)
        for a, b in itq.probes(draw(1000), 0.93):
            assert (tables.keys(a) == tables.keys(b)).any(axis=1).mean() >= 0.95
            assert ((tables.code(a) != tables.code(b)).sum(axis=1) <= tables.radius).mean() >= 0.99
        assert tables.bits >= (10 if common < 0.9 else itq.LEAST_BITS)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_small_tables_go_the_same_way(spark, folder):
    """However few vectors there are, they meet by parts of learnt codes and within a radius that shuts most others out."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    classes = vectors.selectExpr("embedding", "label", "size(embedding) AS dimensions")
    tables = itq._tables(classes, 0.93)[64]
    assert tables.bits >= itq.LEAST_BITS and tables.tables > 1 and tables.rotations
    unit = itq._unit(np.array([r.embedding for r in classes.collect()], np.float64))
    assert np.any(tables.mean) and tables.radius < tables.length / 2
    codes = tables.code(unit)
    apart = (codes[:100, None] != codes[None, 100:300]).sum(axis=2)
    assert (apart > tables.radius).mean() > 0.9


def test_codes_outside_the_radius_are_not_compared(spark, monkeypatch):
    """With a radius of nothing exactly the near vectors of one code link; so few vectors get rotations that are not learnt."""
    monkeypatch.setattr(itq, "SLACK", 0)
    table = clusters(8, 15, lambda g: 3, noise=0.2)
    sizes = [sum(n == label for *_, n in table) for label in range(3)]
    unit = itq._unit(np.array([v for _, v, _ in table], np.float64))
    code = itq.choose_tables(np.zeros((0, 32)), 32, max(sizes), 0.93).code(unit)
    label = np.array([n for *_, n in table])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(table), dtype=bool)
    same = near & (code[:, None] == code[None]).all(axis=2)
    linked = {r[0]: r[1] for r in found(itq.near_duplicates(spark.createDataFrame(table, SCHEMA)))}
    assert linked == {vec_id: n for (vec_id, *_), n in zip(table, same.sum(axis=1).tolist(), strict=True)}
    assert same.sum() < near.sum()


def test_a_pair_is_one_of_its_first_common_part_only():
    rng = np.random.default_rng(9)
    tables = itq.choose_tables(itq._unit(rng.normal(size=(300, 16))), 16, 100, 0.93)
    unit = itq._unit(np.repeat(rng.normal(size=(5, 16)), 4, axis=0) + 0.1 * rng.normal(size=(20, 16)))
    code, keys = tables.code(unit), tables.keys(unit)
    times = np.zeros((20, 20), int)
    for at in range(tables.tables):
        for key in np.unique(keys[:, at]):
            rows = np.flatnonzero(keys[:, at] == key)
            packed = [c.tobytes() for c in np.packbits(code[rows], axis=1)]
            block = pa.table({"at": [at] * len(rows), "low": [0] * len(rows), "high": [0] * len(rows), "part": [0] * len(rows), "code": packed})
            a, b = np.nonzero(itq._near(block, tables))
            times[rows[a], rows[b]] += 1
    shared = (keys[:, None] == keys[None]).any(axis=2) & ((code[:, None] != code[None]).sum(axis=2) <= tables.radius)
    assert (times == np.triu(shared, 1)).all() and times.any()


def test_one_dimension_and_unlearnt_numbers_of_dimensions(spark, monkeypatch):
    monkeypatch.setattr(itq, "MOST_LEARNT", 1)
    table = [(i, [float(i % 5 + 1) * (-1) ** i], 1) for i in range(12)]
    table += [(100 + i, v, n) for i, v, n in clusters(6, 20, lambda g: 1 + g % 4, 8)]
    assert found(itq.near_duplicates(spark.createDataFrame(table, SCHEMA))) == brute(table)


def test_vectors_of_several_dimensions(spark):
    table = [*clusters(5, 60, lambda g: g % 4), *[(1000 + i, v, n) for i, v, n in clusters(6, 60, lambda g: 1 + g % 6, 8)]]
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    assert found(itq.near_duplicates(df)) == brute(table)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_equals_duckdb(spark, folder):
    assert spark_rows(op4_itq_near_dup(spark, folder)) == duckdb_rows(duckdb_over(folder), ORACLE_SQL["op4_itq_near_dup"])


def test_rotation_improves_the_codes():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(500, 16)) * np.linspace(0.2, 2, 16)
    loss = lambda r: np.square(np.where(sample @ r >= 0, 1, -1) - sample @ r).sum()
    learnt = itq.learn_rotation(sample, 1)
    assert np.allclose(learnt @ learnt.T, np.eye(16)) and loss(learnt) < loss(itq.learn_rotation(sample, 1, 0))


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    table = [
        (1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1),
        (8, [1.0, float("nan"), 3.0], 1), (9, [float("inf"), 2.0, 3.0], 1), (10, [], 1), (None, v, 1), (1, v, 1), (11, [1.0, 2.0], 1),
        (12, [1e-30, 2e-30, 3e-30], 1), (13, [1e30, 2e30, 3e30], 1), (14, [-0.0, 1.0, 0.0], 3), (15, [0.0, 1.0, 0.0], 3), (None, None, None),
    ]
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "'clash' AS kept", "0 AS node", "1 AS size")
    assert found(itq.near_duplicates(df)) == brute(table)
    assert itq.near_duplicates(df.limit(0)).count() == 0
