"""Language profiles against a version that walks over the letters, and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import FOLDER, documents, odd_documents, rows
from tracemill.llm import language
from tracemill.llm.queries import op2_language_profiles


def brute_profile(text):
    letter = lambda c: np.random.default_rng([language.SEED, ord(c)]).integers(0, 2, language.DIMENSIONS, np.int8) * 2 - 1
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(clean, clean[1:], clean[2:], strict=False):
        total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total if clean.strip() else 0 * total


TEXTS = ["Hello, World! 12 again", "a", "", "été  à Paris", None, "x\n\ny", "!!", "漢字かな", "the end"]


@pytest.mark.parametrize("table", [language.TABLE, 1])
def test_profiles(monkeypatch, table):
    monkeypatch.setattr(language, "TABLE", table)
    found = language._Trigrams().profiles(TEXTS)
    expected = np.array([brute_profile(t or "") for t in TEXTS])
    assert np.array_equal(found, expected)


def test_kept_vectors_may_run_out(monkeypatch):
    monkeypatch.setattr(language, "KEPT", 32)
    monkeypatch.setattr(language, "BLOCK", 16)
    assert np.array_equal(language._Trigrams().profiles(TEXTS), np.array([brute_profile(t or "") for t in TEXTS]))


def test_predictions(spark):
    table = [(i, t, lang, None, None) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the tree", "en"), ("les arbres", None)] * 6)]
    docs = documents(spark, table)
    held = {r.doc_id: r.held_out for r in docs.select("doc_id", language.held_out(docs.doc_id).alias("held_out")).collect()}
    prototypes = {}
    for i, text, lang, *_ in table:
        if lang and not held[i]:
            prototypes[lang] = prototypes.get(lang, 0) + brute_profile(text)
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for row in language.identify(docs).collect():
        scores = {k: cosine(brute_profile(table[row.doc_id][1]), v) for k, v in prototypes.items()}
        best = max(scores, key=scores.get)
        assert row.held_out == held[row.doc_id] and row.lang_pred == best and row.score == pytest.approx(max(0, scores[best]), abs=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = op2_language_profiles(spark, FOLDER).where("held_out").join(docs, "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count() > 0


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = rows(language.identify(docs).select("doc_id", "lang_pred", "score"))
    assert len(found) == docs.count()
    for doc_id in (2, 3, 4):
        assert (doc_id, "und", 0.0) in found
    assert language.known_documents(docs).columns == docs.columns
    nothing = docs.where("lang IS NULL")
    assert {r[1] for r in rows(language.identify(nothing).select("doc_id", "lang_pred"))} == {"und"}
    assert language.identify(docs.limit(0)).count() == language.known_documents(docs.limit(0)).count() == 0


def noise(n, words):
    rng = random.Random(words)
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    return [" ".join(letters() if i % 2 else f"{rng.getrandbits(32):08x}" for _ in range(words)) for i in range(n)]


@pytest.mark.parametrize("words", [40, 300, 3000])
def test_the_filter_rejects_noise_and_keeps_clean_texts(spark, words):
    """Random letters and hex digits go, documents and their short beginnings stay."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = docs.where("text IS NOT NULL AND lang IS NOT NULL AND n_chars > 200")
    short = clean.withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.array_join(F.slice(F.split("text", " "), 1, 12), " ")})
    made = documents(spark, [(200_000 + i, t, None, "noise", None) for i, t in enumerate(noise(100, words))])
    kept = [r.doc_id for r in language.known_documents(docs.unionByName(short).unionByName(made)).select("doc_id").collect()]
    found = lambda df: len({r.doc_id for r in df.collect()} & set(kept)) / df.count()
    assert found(clean) >= 0.99
    assert found(short) >= 0.99
    assert found(made) <= 0.1


def test_thresholds(spark):
    rows_ = [(10, 0.4 + i / 10_000) for i in range(1000)] + [(12, 0.9)] * 5 + [(3, 0.2)]
    found = language.thresholds(spark.createDataFrame([(s, c) for c, s in rows_], "score double, size int"))
    assert found[10] == pytest.approx(0.6 * 0.401, abs=0.002) and found[12] <= found[10] and found[3] == language.LEAST_SCORE and len(found) == 13
