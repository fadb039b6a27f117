"""Language-model scores: the counted base by loops, and the promises of the model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import FOLDER, SMALL, documents, odd_documents
from tracemill.llm import lm
from tracemill.llm.queries import op6_log_bilinear


def brute_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w] + ["\n"]


def brute_base(texts, held):
    counts = Counter(w for i, t in texts.items() if not held[i] for w in brute_words(t))
    total, distinct = sum(counts.values()), len(counts)
    score = lambda words: sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
    return {
        i: (len(w := brute_words(t)), sum(counts[x] > 0 for x in w), total, score(w)) for i, t in texts.items()
    }


@pytest.mark.parametrize(("head", "length"), [(lm.HEAD_WORDS, lm.HEAD_BYTES), (500, 3), (0, 64)])
def test_base(spark, monkeypatch, head, length):
    """However many and whatever words are broadcast, the base score is that of all counts."""
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "HEAD_BYTES", length)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {r.doc_id: r for r in op6_log_bilinear(spark, SMALL).collect()}
    expected = brute_base(texts, {i: found[i].held_out for i in texts})
    for i, (tokens, known, total, base) in expected.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-12) and math.isfinite(r.score) and r.score < 0


def test_held_out_texts_are_likelier_than_by_counts(spark):
    found = op6_log_bilinear(spark, FOLDER).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert found[0] > found[1]


def small_model():
    model = lm.LogBilinear(np.array([50, 200, 100, 30, 400]), 8)
    rng = np.random.default_rng(1)
    token = np.tile([1, 4, 2, 4, 3, 0], 3000)  # a repeating text
    first, second, token = lm.contexts([token[i : i + 600] for i in range(0, len(token), 600)])
    for start in range(0, len(token), 500):
        model.step(first[start : start + 500], second[start : start + 500], token[start : start + 500], rng)
    return model


def test_probabilities_are_normalised():
    model = small_model()
    for a in range(5):
        for b in range(5):
            logs = model.log_probability(np.full(5, a), np.full(5, b), np.arange(5))
            assert np.exp(logs).sum() == pytest.approx(1, abs=1e-6)


def test_contexts_are_learnt():
    logs = small_model().log_probability(np.array([1, 4, 2]), np.array([4, 2, 4]), np.array([2, 4, 3]))
    assert (np.exp(logs) > 0.5).all()


def test_gradient():
    """A step moves along the derivative of the noise-contrastive objective."""
    counts = np.array([5, 7, 3, 9])
    model = lm.LogBilinear(counts, 3)
    first, second, token = np.array([0, 1, 2]), np.array([3, 1, 0]), np.array([1, 2, 3])
    noise = np.searchsorted(model._cumulated(), np.random.default_rng(4).random(lm.NOISE)).clip(0, 3)

    def objective(flat):
        model.load(flat)
        delta = lambda q, w: (q * model.target[w]).sum(-1) + model.bias[w] - model.noise[w] - np.log(lm.NOISE)
        q = model.predicted(first, second)
        value = np.log(1 / (1 + np.exp(-delta(q, token)))).sum()
        return value + sum(np.log(1 / (1 + np.exp(delta(q, np.full(3, w))))).sum() for w in noise)

    flat = model.flat()
    slopes = np.array([(objective(flat + 1e-5 * e) - objective(flat - 1e-5 * e)) / 2e-5 for e in np.eye(len(flat))])
    model.load(flat)
    model.squares = [np.zeros_like(p) + 1e12 for p in model.parameters]
    model.step(first, second, token, np.random.default_rng(4))
    assert (model.flat() - flat) * 3 * 1e6 / lm.RATE == pytest.approx(slopes, rel=1e-3, abs=1e-6)


def test_words_of_many_held_out_texts_only(spark):
    """A word that no training text has is unknown, however often it comes."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = documents(spark, [(i, "unseen " * 5 + "seen" if i in held else "seen words here") for i in range(400)])
    row = lm.score(docs).where(f"doc_id = {held[0]}").first()
    assert row.held_out and (row.n_tokens, row.n_known) == (7, 2)


def known_words(spark, texts, monkeypatch, own=2):
    monkeypatch.setattr(lm, "CLASS_WORDS", own)
    return lm.vocabulary(lm.token_counts(documents(spark, list(enumerate(texts)))))


def test_bins_grow_with_the_words_and_are_normalised(spark, monkeypatch):
    """Over all words, one not known in each bin included, the probabilities add up to 1 in every context."""
    few, many = (known_words(spark, [" ".join(f"w{i % n}" for i in range(k, k + 9)) for k in range(400)], monkeypatch) for n in (30, 300))
    assert few.bins < many.bins
    model, reader = lm.Model(many), lm.Reader(many)
    model.load(np.random.default_rng(5).normal(0, 0.5, len(model.flat())))
    own, rare = many.head[:2], many.head[2:]
    counts = dict(zip(many.head, many.counts.tolist(), strict=True))
    for context in ([b"w5", b"w7"], [b"w5", many.head[0]]):
        total = 0.0
        for word in own + rare:
            found = [*context, word]
            log = model.log_probability([reader.classes(found, reader.places(found))])[2]
            total += np.exp(log) * (counts[word] + 1 if word in rare else 1)
        found = context
        total += np.exp(model.log_probability([reader.classes(found, reader.places(found))])[2])  # the end
        one = {}
        for i in range(100_000):
            one.setdefault(zlib.crc32(b"new%d" % i) % many.bins, b"new%d" % i)
        assert len(one) == many.bins
        for word in one.values():
            found = [*context, word]
            total += np.exp(model.log_probability([reader.classes(found, reader.places(found))])[2])
        assert total == pytest.approx(1, abs=1e-4)


def test_rare_words_are_told_by_their_context(spark, monkeypatch):
    """Among words without a class of their own the one that always follows is likelier than by its count."""
    monkeypatch.setattr(lm, "BIN_SHARE", 4)
    texts = ["a b " + " ".join(f"x{(7 * k + j) % 40} y{(7 * k + j) % 40}" for j in range(30)) for k in range(300)]
    known = known_words(spark, texts, monkeypatch)
    model, reader, rng = lm.Model(known), lm.Reader(known), np.random.default_rng(1)
    coded = [reader.classes(w, reader.places(w)) for w in map(lm.words, texts)]
    for _ in range(10):
        model.learn(coded, rng)
    log = lambda a, b: model.log_probability([reader.classes([a, b], reader.places([a, b]))])[1]
    right = [log(b"x%d" % i, b"y%d" % i) > log(b"x%d" % (i + 11), b"y%d" % i) for i in range(25)]
    assert sum(right) >= 22


def test_words_keep_their_classes_where_the_head_overflows(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 10)
    known = known_words(spark, [" ".join(f"w{i}" for i in range(50))] * 3, monkeypatch, 5)
    assert known.classes == 7 and known.head == sorted(b"w%d" % i for i in range(50))[:5]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = lm.score(docs).collect()
    assert len(found) == docs.count()
    assert {(r.doc_id, r.n_tokens) for r in found} >= {(2, 1), (3, 1), (4, 1), (None, 1), (5, 30_001)}
    assert lm.score(docs.limit(0)).count() == 0
    only_held = documents(spark, [(i, "some text") for i in range(30)]).where(lm.held_out(F.col("doc_id")))
    rows = lm.score(only_held).collect()
    assert rows and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score < 0 for r in rows)
