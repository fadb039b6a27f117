"""Quality rules: log-likelihood ratio of hashed n-grams between trusted documents and the whole corpus.

Two multinomials over hashed n-grams are counted: one of trusted documents, one of all documents. A
document's score is the mean over its n-grams of the logarithm of the ratio of both probabilities.
Every document is judged by fixed thresholds; nothing is drawn at random.

N-grams are runs of four bytes of the words, joined by single spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import free_name, per_text, pieces

NGRAM = 4
BUCKETS = 1 << 16
#: Added to the count of every bucket.
SMOOTHING = 1.0
#: A document goes if its n-grams are, on average, less likely than this under the trusted documents.
#: Texts in a language that few trusted documents have stay above it.
LEAST_RATIO = -0.3
#: Base rules.
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\t\n\x0b\x0c\r"
#: Labelled documents that the trusted multinomial is taken from, about, at most. It bounds what is broadcast.
TRUSTED_ROWS = 100_000

#: An n-gram is a 32-bit number; its bucket is the upper half of its product with this.
MULTIPLIER = np.uint32(0x9E3779B1)
WINDOW_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

VERDICT = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_ngrams", pa.int64()), ("ratio", pa.float64()),
])
_VERDICT_SQL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_ngrams long, ratio double"
)


def buckets(words: list[bytes]) -> np.ndarray:
    """Bucket of every n-gram; a text shorter than one n-gram has none."""
    data = b" ".join(words)
    if len(data) < NGRAM:
        return np.zeros(0, np.int64)
    grams = np.ndarray(len(data) - NGRAM + 1, "<u4", data, strides=(1,))
    return (grams * MULTIPLIER >> np.uint32(16)).astype(np.int64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which is found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = {word: i for i, word in enumerate(dict.fromkeys(words))}
    if len(ids) == len(words):
        return 0
    numbers = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    hashed = np.zeros(n, np.uint64)
    for i in range(window):
        hashed = hashed * WINDOW_MULTIPLIER + numbers[i : i + n].astype(np.uint64)
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    if not same.any():
        return 0
    # Windows of equal hash are compared word by word with the one before them in their run.
    runs = np.lib.stride_tricks.sliding_window_view(numbers, window)
    pairs = np.flatnonzero(same)
    equal = np.ones(len(pairs), bool)
    for start in range(0, len(pairs), 4096):
        part = pairs[start : start + 4096]
        equal[start : start + 4096] = (runs[order[part]] == runs[order[part + 1]]).all(axis=1)
    if equal.all():
        found = np.zeros(n, bool)
        found[order[pairs]] = found[order[pairs + 1]] = True
    else:  # two different windows have one hash
        seen: dict[bytes, int] = {}
        keys = [run.tobytes() for run in runs]
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        found = np.array([seen[key] > 1 for key in keys])
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += found
    edges[window : window + n] -= found
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def measures(text: str | None, weights: np.ndarray) -> tuple:
    """The fields of ``VERDICT``; the ratio of a text without n-grams is 0."""
    text = text or ""
    words = text.encode().split()
    grams = buckets(words)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(text),
        repeated_words(words), len(grams), float(weights[grams].mean()) if len(grams) else 0.0,
    )


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """``doc_id`` of labelled documents of quality that are not toxic, about ``rows`` at most.

    A document with several labels is trusted if all of them agree. Above ``rows`` documents, those
    whose hashed id lies below the share that is wanted are taken: the expected number is ``rows``
    and hardly varies, at any size, and a rerun takes the same.
    """
    good = (F.col("quality") == 1) & ~(F.coalesce("toxic", F.lit(0)) == 1)
    agreed = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
    ids = agreed.where("good").select("doc_id")
    share = rows / max(rows, ids.count())
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """Logarithm of the ratio of probabilities, per bucket; all 0 if no trusted document has an n-gram.

    Every task adds up its documents in two arrays of ``BUCKETS`` numbers, so at most two rows a
    bucket and task are shuffled, and the driver gets two numbers per bucket.
    """
    trusted = F.broadcast(trusted_ids(labels, rows).withColumn("trusted", F.lit(True)))
    marked = docs.select("doc_id", "text").join(trusted, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    partial = marked.mapInArrow(_count, "bucket int, trusted long, everything long")
    counted = partial.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("everything").alias("everything"))
    counts = np.zeros((2, BUCKETS))
    for row in counted.collect():
        counts[:, row.bucket] = row.trusted, row.everything
    if not counts[0].any():
        return np.zeros(BUCKETS)
    shares = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(shares[0]) - np.log(shares[1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        trusted, at = batch["trusted"].to_pylist(), 0
        for piece in pieces(batch["text"]):
            grams = [buckets((text or "").encode().split()) for text in piece]
            marked = [g for g, good in zip(grams, trusted[at : at + len(piece)], strict=True) if good]
            at += len(piece)
            counts[1] += np.bincount(np.concatenate(grams), minlength=BUCKETS)
            if marked:
                counts[0] += np.bincount(np.concatenate(marked), minlength=BUCKETS)
    used = np.flatnonzero(counts[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), *map(pa.array, counts[:, used])], ["bucket", "trusted", "everything"]
    )


def _measured(docs: DataFrame, labels: DataFrame) -> Column:
    weights = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    body = per_text(lambda texts: [measures(t, weights.value) for t in texts], VERDICT)
    return F.arrow_udf(body, _VERDICT_SQL).asNondeterministic()("text")


def _rules(field) -> tuple[Column, Column]:
    failed = (field("n_words") < LEAST_WORDS) | (100 * field("n_repeat_words") > MOST_REPEATED_PERCENT * field("n_words"))
    return failed, ~failed & (field("ratio") >= LEAST_RATIO)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id``, the base counts, ``base_failed``, ``kept``, and the score ``ratio`` over ``n_ngrams``.

    A null text has no words and fails the base rules. Without trusted documents every ratio is 0
    and the base rules alone decide. Rows that repeat an id are judged each; other columns are not
    read. Texts are read twice and not shuffled.
    """
    judged = docs.select("doc_id", _measured(docs, labels).alias("v")).select("doc_id", "v.*")
    failed, kept = _rules(F.col)
    return judged.withColumn("base_failed", failed).withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_ngrams", "ratio",
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    name = free_name(docs, "quality")
    judged = docs.withColumn(name, _measured(docs, labels))
    return judged.where(_rules(lambda c: F.col(f"{name}.{c}"))[1]).select(*docs.columns)
