"""Quality scores of documents: kernel ridge regression over statistics of the text, calibrated.

A text is described by some twenty statistics of its letters, words and lines. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; labelled documents give the normal equations of a
ridge regression on them, which tasks add up for their own rows. An increasing step function from scores to the
share of good documents, fitted by pooling adjacent violators, turns a score into a probability.

Labels are learnt in two folds. The scores that are calibrated are those of the model of the other fold,
so that no document is scored by what was learnt from it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import per_text, stored
from tracemill.llm.quality import repeated_lines, repeated_words
from tracemill.operators.joins import lookup_join

#: Random features; the model has one parameter each and a constant.
FEATURES = 256
#: Width of the kernel, in standard deviations of a statistic times the root of their number.
WIDTH = 0.7
RIDGE = 1.0
#: Standardised statistics beyond this are taken as this.
FURTHEST = 5.0
SEED = 20_071_203
FOLDS = 2
#: Scores are calibrated in so many cells between these bounds.
CELLS, LOWEST, HIGHEST = 4096, -1.0, 2.0
#: Rows that are turned into features at once.
ROWS = 4096

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_STOP = np.isin(np.arange(256), list(b".,;:?"))
_LOUD = np.isin(np.arange(256), list(b"!"))
_QUOTE = np.isin(np.arange(256), list(b"'\"()-"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_HIGH = np.arange(256) >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _STOP | _LOUD | _QUOTE | _SPACE | _HIGH)
_KINDS = np.stack([_UPPER, _DIGIT, _STOP, _LOUD, _QUOTE, _SYMBOL, _HIGH]).astype(np.float64)
STATISTICS = 21


def statistics(text: str | None) -> list[float]:
    """What is known of a text; all 0 for one without a word."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * STATISTICS
    used = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = len(data) - int(used[_SPACE].sum())
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    frequent = sum(c for _, c in counts.most_common(3))
    lines = [line for line in text.split("\n") if line.strip()]
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [
        math.log1p(n), math.log1p(len(lines)), math.log(n / len(lines)), float(sizes.mean()), float(sizes.std()), math.log(float(sizes.max())),
        *np.sqrt(_KINDS @ used / letters).tolist(),
        math.log(len(counts)) / math.log(n + 1), frequent / n, again / n, math.sqrt(repeated_words(words) / n), repeated_lines(text) / len(lines),
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n, sum(1 for w in words if len(w) == 1) / n,
    ]


def held_out(doc_id: Column) -> Column:
    """CRC-32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every text."""
    kind = pa.struct([("x", pa.list_(pa.float64()))])
    body = per_text(lambda texts: [(statistics(t),) for t in texts], kind)
    return docs.select("doc_id", F.arrow_udf(body, "x array<double>")("text").alias("v")).select("doc_id", "v.x")


def examples(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``x, y, fold`` of every row of ``documents`` that may be learnt from, once per label of its id.

    A label is the number of its rows with this quality: equal rows of a hot id are one row with a weight.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = marked.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("good"),
    )
    fold = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, 0).otherwise(1)
    return lookup_join(documents, known, ["doc_id"]).select("x", "n", "good", fold.alias("fold"))


@dataclass
class Model:
    """Scale of the statistics, random directions, parameters of each fold and of all, and the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    parameters: np.ndarray | None = None  # of the fold, then of all
    at: np.ndarray | None = None
    share: np.ndarray | None = None

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.directions = rng.normal(0, 1 / (WIDTH * math.sqrt(STATISTICS)), (STATISTICS, FEATURES))
        self.phases = rng.uniform(0, 2 * math.pi, FEATURES)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -FURTHEST, FURTHEST)
        waves = math.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, which: int = -1) -> np.ndarray:
        return self.features(x) @ self.parameters[which]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of good documents at each score; between two levels of the step function it rises in a line."""
        if self.at is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.at, self.share)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over ``rows``; Spark adds them up."""
    per = [F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])) for i in range(STATISTICS)]
    found = np.array([[v[0] or 0.0, v[1] or 0.0] for v in rows.agg(*per).first()])
    return found[:, 0], np.where(found[:, 1] > 1e-9, found[:, 1], 1.0)


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per fold the sum of outer products of the features, and of features times labels.

    A task sends its sums once: the upper triangle, some 33,000 numbers a fold.
    """
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, seen = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS, bool)
        for batch in batches:
            x, n, good, fold = _matrix(batch["x"]), *(batch[c].to_numpy() for c in ("n", "good", "fold"))
            for start in range(0, len(x), ROWS):
                part = slice(start, start + ROWS)
                z = model.features(x[part])
                for k in range(FOLDS):
                    mine = np.flatnonzero(fold[part] == k)
                    seen[k] |= len(mine) > 0
                    products[k] += (z[mine] * n[part][mine, None]).T @ z[mine]
                    sums[k] += good[part][mine] @ z[mine]
        for k in np.flatnonzero(seen).tolist():
            values = np.concatenate([products[k][upper], sums[k]])
            at = np.arange(len(values)) * FOLDS + k
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(values)], ["at", "value"])

    found = rows.mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(FOLDS * (len(upper[0]) + size))
    flat[found["at"].to_numpy()] = found["value"].to_numpy()
    flat = flat.reshape(-1, FOLDS).T
    products = np.zeros((FOLDS, size, size))
    products[:, upper[0], upper[1]] = products[:, upper[1], upper[0]] = flat[:, : len(upper[0])]
    return products, flat[:, len(upper[0]) :]


def ridge(products: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Parameters by fold, and of all folds; the constant is hardly held back."""
    held = np.full(FEATURES + 1, RIDGE)
    held[-1] = 1e-6
    return np.stack([np.linalg.solve(a + np.diag(held), b) for a, b in zip([*products, products.sum(0)], [*sums, sums.sum(0)], strict=True)])


def pooled(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: mean score and share of good rows of each level, both increasing."""
    levels: list[list[float]] = []
    for s, g, w in zip(score.tolist(), good.tolist(), n.tolist(), strict=True):
        levels.append([s * w, g, w])
        while len(levels) > 1 and levels[-2][1] * levels[-1][2] >= levels[-1][1] * levels[-2][2]:
            last = levels.pop()
            levels[-1] = [a + b for a, b in zip(levels[-1], last, strict=True)]
    sums = np.array(levels).reshape(-1, 3)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def calibrate(rows: DataFrame, model: Model) -> None:
    """Fit the step function to the scores that the other fold's model gives; a cell of scores is one row."""
    step = (HIGHEST - LOWEST) / CELLS

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, CELLS))
        for batch in batches:
            x, n, good, fold = _matrix(batch["x"]), *(batch[c].to_numpy() for c in ("n", "good", "fold"))
            for start in range(0, len(x), ROWS):
                part = slice(start, start + ROWS)
                both = model.features(x[part]) @ model.parameters[:FOLDS].T
                score = np.clip(both[np.arange(len(both)), 1 - fold[part]], LOWEST, HIGHEST)
                at = np.minimum((score - LOWEST) / step, CELLS - 1).astype(np.int64)
                for k, weight in enumerate((score * n[part], good[part], n[part])):
                    sums[k] += np.bincount(at, weight, CELLS)
        used = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *map(pa.array, sums[:, used])], ["cell", "score", "good", "n"])

    partial = rows.mapInArrow(cells, "cell int, score double, good double, n double")
    found = partial.groupBy("cell").agg(F.sum("score").alias("score"), F.sum("good").alias("good"), F.sum("n").alias("n")).toArrow()
    order = np.argsort(found["cell"].to_numpy())
    score, good, n = (found[c].to_numpy()[order] for c in ("score", "good", "n"))
    if len(n):
        model.at, model.share = pooled(score / n, good, n)


def learn(rows: DataFrame) -> Model:
    """The model of ``rows`` (x, n, good, fold); without rows it gives 0.5 to every text."""
    model = Model(*scale(rows))
    products, sums = normal_equations(rows, model)
    if products[:, -1, -1].sum() > 0:
        model.parameters = ridge(products, sums)
        if (products[:, -1, -1] == 0).any():  # one fold is empty: its model is that of the other
            model.parameters[:FOLDS] = model.parameters[FOLDS]
        calibrate(rows, model)
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``, from its text alone.

    A null text is empty; texts without a word are learnt from and scored like others. Rows that repeat an id
    are documents each; a null id has no label and is not held out. Labels without quality do not count, and of
    several labels of an id each does. Without any label every score is 0.5. Other columns are not
    read. Texts are read once and not shuffled: their statistics are, to meet the labels.
    """
    documents = stored(measured(docs), "statistics")
    rows = stored(examples(documents.where(~held_out(F.col("doc_id"))), labels), "examples")
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows))

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        z = _matrix(x)
        parts = [shared.value.score(z[start : start + ROWS]) for start in range(0, len(z), ROWS)]
        return pa.array(np.clip(np.concatenate(parts), 0, 1) if parts else [], pa.float64())

    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
