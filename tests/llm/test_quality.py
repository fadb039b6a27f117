"""Quality rules against a version that counts with plain loops."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.fixtures import FOLDER, documents, odd_documents, rows
from tracemill.llm import quality
from tracemill.llm.queries import op1_quality_ratio

SPACES = " \t\n\x0b\x0c\r"


def brute_words(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute_base(text):
    text = text or ""
    words = brute_words(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if brute_words(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def brute_grams(text):
    data = " ".join(brute_words(text or "")).encode()
    return [(int.from_bytes(data[i : i + 4], "little") * 0x9E3779B1 % 2**32) >> 16 for i in range(len(data) - 3)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#|é漢"), max_size=120))
def test_base_counts(text):
    assert quality.measures(text, np.zeros(quality.BUCKETS))[:5] == brute_base(text)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    words = [b"%d" % (i % 7) for i in range(60)] + [b"x%d" % i for i in range(30)]
    expected = quality.repeated_words(words)
    monkeypatch.setattr(quality, "WINDOW_MULTIPLIER", np.uint64(0))  # only the last word counts
    assert quality.repeated_words(words) == expected == brute_base(b" ".join(words).decode())[4]


def test_against_loops(spark):
    table = [(i, f"word{i % 5} text number {i} " * (2 + i % 3) + "and some more words to be long enough " * 3) for i in range(40)]
    table += [(100 + i, "### " * 40 + f"junk{i}") for i in range(10)]
    docs = documents(spark, table)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(100, 0, 0), (1, 1, 1), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    trusted, raw = Counter(), Counter()
    for doc_id, text in table:
        raw.update(brute_grams(text))
        if doc_id in range(0, 40, 2):
            trusted.update(brute_grams(text))
    total = lambda c: sum(c.values()) + quality.BUCKETS
    found = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(found) == len(table)
    for doc_id, text in table:
        grams = brute_grams(text)
        ratio = sum(math.log((trusted[g] + 1) / total(trusted)) - math.log((raw[g] + 1) / total(raw)) for g in grams) / len(grams)
        row = found[doc_id]
        base = brute_base(text)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == base
        assert row.n_ngrams == len(grams) and row.ratio == pytest.approx(ratio, abs=1e-9)
        assert row.base_failed == failed and row.kept == (not failed and ratio >= quality.LEAST_RATIO)


def test_labelled_documents_are_told_apart(spark):
    judged = op1_quality_ratio(spark, FOLDER).where("NOT base_failed")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0")
    counts = {(r.quality, r.kept): r["count"] for r in judged.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert (1, False) not in counts and counts[1, True] > 200
    assert counts.get((0, True), 0) <= 0.1 * counts[0, False]


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    judged = rows(quality.judge(docs, labels).select("doc_id", "n_words", "base_failed", "kept"))
    assert len(judged) == docs.count()
    assert (2, 0, True, False) in judged and judged.count((1, 9, True, False)) == 2
    assert quality.kept_documents(docs, labels).columns == docs.columns
    no_labels = labels.limit(0)
    assert quality.judge(docs, no_labels).where("ratio <> 0").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == quality.kept_documents(docs.limit(0), no_labels).count() == 0


def test_the_trusted_sample_is_bounded(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    taken = quality.trusted_ids(labels, 2_000).count()
    assert 1_700 < taken < 2_300
    assert quality.trusted_ids(labels, 50_000).count() == 20_000
