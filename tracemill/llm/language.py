"""Language identification with hyperdimensional profiles.

Every letter, and the space between words, is a random vector of +1 and -1. A trigram is the product
of its three letter vectors, the first rotated twice and the second once, so that their order
matters. A text is the sum of its trigram vectors, a language the sum of its training texts, and a
text takes the language of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import PIECE_CHARS, PIECE_ROWS, free_name, per_text, pieces, stored

DIMENSIONS = 1024
SEED = 20_080_601
UNKNOWN = "und"
#: The filter: a text is in none of the languages if its cosine is below this share of what all but ``UNLIKE`` of the
#: learning documents of its size reach, or below ``LEAST_SCORE``. A size is half a doubling of the number of
#: trigrams; one with fewer than ``SUPPORT`` documents borrows those of smaller sizes, whose cosines are lower.
NEAR, UNLIKE, LEAST_SCORE, SUPPORT = 0.6, 0.01, 0.05, 100
#: Cells of the cosine from 0 to 1 by which learning documents are counted.
CELLS = 400
#: More languages than this are refused: the prototypes are held by the driver and every task.
MOST_LANGUAGES = 4096
#: Trigram vectors that a worker keeps, and trigrams that are multiplied at once.
KEPT, BLOCK = 8192, 4096
#: Up to this many combinations trigrams are counted in a table, beyond it by sorting.
TABLE = 1 << 22
_SPACE, _UNSEEN = 32, 0xFFFFFFFF

PREDICTION = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("size", pa.int32())])


class _Trigrams:
    """Vectors of trigrams, and counts of trigrams in texts."""

    def __init__(self):
        self.letters: dict[int, np.ndarray] = {}
        self.vectors = np.zeros((KEPT, DIMENSIONS), np.float32)
        self.place: dict[int, int] = {}
        self.classes = np.full(0x110000, _UNSEEN, np.uint32)
        self.classes[_SPACE] = _SPACE

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
        return self.letters[code]

    def _vector(self, key: int) -> np.ndarray:
        first, second, third = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self._letter(first), 2) * np.roll(self._letter(second), 1) * self._letter(third)

    def matrix(self, keys: np.ndarray) -> np.ndarray:
        """One row per key; at most ``BLOCK`` keys."""
        new = [k for k in keys.tolist() if k not in self.place]
        if len(self.place) + len(new) > KEPT:
            self.place, new = {}, keys.tolist()
        for key in new:
            at = self.place[key] = len(self.place)
            self.vectors[at] = self._vector(key)
        return self.vectors[[self.place[k] for k in keys.tolist()]]

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts, lower case, every run without letters one space; and the text of each."""
        padded = [f" {(t or '').lower()} " for t in texts]
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
        kinds = self.classes[codes]
        if (kinds == _UNSEEN).any():
            for code in np.unique(codes[kinds == _UNSEEN]).tolist():
                self.classes[code] = code if chr(code).isalpha() else _SPACE
            kinds = self.classes[codes]
        keep = np.ones(len(kinds), bool)
        keep[1:] = (kinds[1:] != _SPACE) | (kinds[:-1] != _SPACE)
        return kinds[keep], owner[keep]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Different trigrams of the texts as keys, and how often each text has each of them."""
        codes, owner = self._codes(texts)
        if len(codes) < 3:
            return np.zeros(0, np.int64), np.zeros((len(texts), 0), np.float32)
        # Around the space between two texts: a trigram over both of them is none.
        inside = (owner[:-2] == owner[2:]) | (codes[1:-1] != _SPACE)
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        alphabet = np.flatnonzero(seen)
        number = np.zeros(0x110000, np.int64)
        number[alphabet] = np.arange(len(alphabet))
        n = number[codes]
        grams = ((n[:-2] * len(alphabet) + n[1:-1]) * len(alphabet) + n[2:])[inside]
        text = owner[1:-1][inside]
        if len(alphabet) ** 3 <= TABLE:
            held = np.zeros(len(alphabet) ** 3, np.int64)
            held[grams] = 1
            used = np.flatnonzero(held)
            held[used] = np.arange(len(used))
            column = held[grams]
        else:
            used, column = np.unique(grams, return_inverse=True)
        flat = np.bincount(text * len(used) + column, minlength=len(texts) * len(used))
        first, rest = np.divmod(used, len(alphabet) ** 2)
        second, third = np.divmod(rest, len(alphabet))
        keys = alphabet[first] << 42 | alphabet[second] << 21 | alphabet[third]
        return keys, flat.reshape(len(texts), len(used)).astype(np.float32)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of trigram vectors, one row per row of ``counts``."""
        total = np.zeros((len(counts), DIMENSIONS), np.float32)
        for start in range(0, len(keys), BLOCK):
            total += counts[:, start : start + BLOCK] @ self.matrix(keys[start : start + BLOCK])
        return total

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        return self.bundle(*self.counts(texts))


_worker: list[_Trigrams] = []


def _trigrams() -> _Trigrams:
    """The one of this worker process."""
    if not _worker:
        _worker.append(_Trigrams())
    return _worker[0]


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype per language from ``lang, text``; null languages and texts without letters add nothing.

    Tasks add up their texts first: they send ``DIMENSIONS`` sums per language. A text's sums are whole
    numbers, so the order in which they are added does not matter.
    """
    known = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    partial = known.mapInArrow(_bundles, "lang string, at int, value long")
    sums = partial.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    prototypes: dict[str, np.ndarray] = {}
    rows = sums.groupBy("lang").agg(F.collect_list(F.struct("at", "value")).alias("parts")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    for row in rows:
        vector = np.zeros(DIMENSIONS)
        for at, value in row.parts:
            vector[at] = value
        if vector.any():
            prototypes[row.lang] = vector
    return dict(sorted(prototypes.items()))


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, at = batch["lang"].to_pylist(), 0
        for piece in pieces(batch["text"], PIECE_CHARS, PIECE_ROWS):
            names = langs[at : at + len(piece)]
            at += len(piece)
            keys, counts = _trigrams().counts(piece)
            for lang in dict.fromkeys(names):
                mine = counts[[n == lang for n in names]].sum(axis=0, keepdims=True)
                bundle = _trigrams().bundle(keys, mine)[0].astype(np.int64)
                sums[lang] = sums.get(lang, 0) + bundle
        if len(sums) > 256:
            yield from _rows(sums)
            sums = {}
    yield from _rows(sums)


def _rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, vector in sums.items():
        at = np.arange(DIMENSIONS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(at), pa.array(vector)], ["lang", "at", "value"])


def predict(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> list[tuple[str, float, int]]:
    """Language, cosine, cut to 0..1, and size per text; ties take the first name. ``prototypes`` have length 1."""
    keys, counts = _trigrams().counts(texts)
    profiles = _trigrams().bundle(keys, counts).astype(np.float64)
    sizes = np.floor(2 * np.log2(counts.sum(axis=1, dtype=np.float64) + 1)).astype(int).tolist()
    lengths = np.linalg.norm(profiles, axis=1)
    if not names:
        return [(UNKNOWN, 0.0, size) for size in sizes]
    cosines = (profiles @ prototypes.T) / np.maximum(lengths, 1e-300)[:, None]
    best = cosines.argmax(axis=1)
    lettered = [any(map(str.isalpha, t or "")) for t in texts]
    return [
        (names[b], float(np.clip(cosines[i, b], 0, 1)), sizes[i]) if lettered[i] else (UNKNOWN, 0.0, sizes[i])
        for i, b in enumerate(best.tolist())
    ]


def held_out(doc_id: Column) -> Column:
    """Whether a document is only tested on: CRC-32 of its id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predictions(docs: DataFrame) -> Column:
    """Struct ``lang_pred, score, size`` of the column ``text``, learnt from those of ``docs`` that are not held out."""
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))))
    names = list(prototypes)
    unit = np.array([v / np.linalg.norm(v) for v in prototypes.values()]).reshape(len(names), DIMENSIONS)
    shared = docs.sparkSession.sparkContext.broadcast(unit)
    body = per_text(lambda texts: predict(texts, names, shared.value), PREDICTION)
    return F.arrow_udf(body, "lang_pred string, score double, size int").asNondeterministic()("text")


def identify(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
    could be learnt. A null id is not held out. Rows that repeat an id are predicted each; columns
    other than ``doc_id, text, lang`` are not read. Texts are read twice and not shuffled.
    """
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictions(docs).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


def thresholds(learnt: DataFrame) -> list[float]:
    """Least cosine per size, from ``score, size`` of the learning documents, counted in cells."""
    cell = F.least(F.floor(F.col("score") * CELLS), F.lit(CELLS - 1)).cast("int").alias("cell")
    counted = learnt.groupBy("size", cell).agg(F.count("*").alias("n")).collect()  # some sizes, each with CELLS rows at most
    counts = np.zeros((max((r["size"] for r in counted), default=0) + 1, CELLS), np.int64)
    for r in counted:
        counts[r["size"], r["cell"]] = r["n"]
    found = []
    for size in range(len(counts)):
        pooled, lower = counts[size].copy(), size
        while pooled.sum() < SUPPORT and lower:
            lower -= 1
            pooled += counts[lower]
        reached = np.searchsorted(np.cumsum(pooled), UNLIKE * pooled.sum(), side="right") / CELLS
        found.append(max(LEAST_SCORE, NEAR * float(reached)) if pooled.sum() >= SUPPORT else LEAST_SCORE)
    return found


def known_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of the languages.

    Each is scored once and kept with its score until the thresholds are known, which all learning documents
    that are told right give. A text without a letter goes; so does every text if nothing could be learnt.
    """
    name = free_name(docs, "language")
    scored = stored(docs.withColumn(name, predictions(docs)), "language")
    right = ~held_out(F.col("doc_id")) & (F.col("lang") == F.col(f"{name}.lang_pred"))
    least = thresholds(scored.where(right).select(f"{name}.score", f"{name}.size"))
    # A size beyond all that are known has the threshold of the largest.
    wanted = F.get(F.array(*map(F.lit, least)), F.least(F.col(f"{name}.size"), F.lit(len(least) - 1)))
    return scored.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= wanted)).select(*docs.columns)
