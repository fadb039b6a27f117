"""The quality classifier: held-out labels, and its parts against plain numpy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import FOLDER, documents, odd_documents
from tracemill.llm import classifier
from tracemill.llm.queries import op12_kernel_ridge

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = op12_kernel_ridge(spark, FOLDER)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 100 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    above = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert above > 0.98 and np.mean([r.predicted == r.quality for r in rows]) > 0.96


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda labels: {r.doc_id: r.score for r in classifier.classify(docs.drop("lang", "source"), labels).collect()}
    one, two = scores(labels), scores(turned)
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], abs=1e-9) for i in one)


def example_rows(spark, seed=1, n=300, signs=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, classifier.STATISTICS))
    x[:, 3] = 5  # never varies
    if signs:
        x[:, 2:] = 0
    good = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = [(v.tolist(), 1 + i % 2, int(g) * (1 + i % 2), i % 2) for i, (v, g) in enumerate(zip(x, good, strict=True))]
    return spark.createDataFrame(rows, "x array<double>, n long, good long, fold int").repartition(4), x, good


def test_sums_over_tasks_equal_numpy(spark):
    rows, x, good = example_rows(spark)
    mean, deviation = classifier.scale(rows)
    assert mean == pytest.approx(x.mean(0)) and deviation[:3] == pytest.approx(x.std(0)[:3]) and deviation[3] == 1
    model = classifier.Model(mean, deviation)
    products, sums = classifier.normal_equations(rows, model)
    z, weight, fold = model.features(x), 1 + np.arange(len(x)) % 2, np.arange(len(x)) % 2
    for k in range(2):
        mine = fold == k
        assert products[k] == pytest.approx((z[mine] * weight[mine, None]).T @ z[mine])
        assert sums[k] == pytest.approx((good * weight)[mine] @ z[mine])


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(5)
    model = classifier.Model(np.zeros(classifier.STATISTICS), np.ones(classifier.STATISTICS))
    x = rng.normal(0, 0.5, (60, classifier.STATISTICS))
    z = model.features(x)[:, :-1]
    distance = ((x[:, None] - x) ** 2).sum(2)
    kernel = np.exp(-distance / (2 * classifier.WIDTH**2 * classifier.STATISTICS))
    assert np.abs(z @ z.T - kernel).mean() < 0.06


def test_what_no_line_can_tell_is_learnt(spark):
    """Good are those whose first two statistics have one sign."""
    rows, _, _ = example_rows(spark, n=1500, signs=True)
    model = classifier.learn(rows)
    _, x, good = example_rows(spark, seed=2, n=400, signs=True)
    assert ((model.score(x) >= 0.5) == good).mean() > 0.75
    assert (np.diff(model.share) > 0).all() and (np.diff(model.at) > 0).all()


def test_pooled_equals_the_best_increasing_fit():
    """Against max-min formulas of isotonic regression."""
    rng = np.random.default_rng(3)
    score, n = np.sort(rng.random(40)), rng.integers(1, 5, 40).astype(float)
    good = np.floor(n * np.clip(score + rng.normal(0, 0.4, 40), 0, 1))
    fit = [
        max(min(good[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)
    ]
    at, share = classifier.pooled(score, good, n)
    assert sorted(set(np.round(fit, 9))) == pytest.approx(np.round(share, 9).tolist())
    assert (np.diff(at) > 0).all()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, None), (2, 0, 0), (3, None, 0), (None, 1, 0), (5, 1, 1), (6, 1, 0), (99, 0, 0), (5, 1, 1)], LABELS
    ).withColumn("x", F.lit("clash"))
    found = classifier.classify(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    assert classifier.classify(docs.limit(0), labels).count() == 0
    without = classifier.classify(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in without} == {(0.5, 1)}
    one_fold = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert all(0 <= r.score <= 1 for r in classifier.classify(documents(spark, [(i, "text " * i) for i in range(9)]), one_fold).collect())
