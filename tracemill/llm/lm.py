"""Language-model scores: a log-bilinear neural model, trained with noise-contrastive estimation.

The two words before a token each have a vector; weighted by position and added, they predict the
token's vector. A token's score is the product of both plus a bias. Training tells true tokens from
tokens drawn by frequency, so it needs no sum over the vocabulary. Scoring normalises: per
pair of context words one row of a matrix product gives the scores of all classes.

The classes are the end of a text, the most frequent words, and one class for all rarer words. Those are
dealt by hash into bins, more of them the more words there are, and bins lie in groups of as many bins as there are
groups. Two more models of the same kind predict the group of a rare word and its bin in the group, and there bins are
context words, too; in its bin a word has the probability of its smoothed count. So every text has a probability,
whatever its words, and its cost grows with the root of the bins, not with their number.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import pieces, stored
from tracemill.operators.joins import lookup_join

#: Words that have a class of their own, at most.
CLASS_WORDS = 1022
DIMENSIONS = 16
#: Bins of rare words: this many times the root of the number of words.
BIN_SHARE = 0.5
#: Words that are broadcast with their counts, at most; all others meet their counts in a join.
HEAD_WORDS = 100_000
#: Longer words are never broadcast, so that the head has a size.
HEAD_BYTES = 64
#: Rows that one task adds up before it sends them on.
HELD_WORDS = 200_000
#: Training: tokens and shared noise tokens per step, and the step size of AdaGrad.
BATCH, NOISE, RATE = 1024, 32, 0.3
#: Tokens per step of the models of rare words.
RARE_BATCH = 8192
#: Gradients are summed over a step and divided by these, for classes and for the models of rare words, so larger steps move as far.
PER, RARE_PER = 256, 512
SEED = 20_120_626
#: Tokens that a task gathers before it trains on them.
HELD_TOKENS = 1 << 15
END, END_WORD = 0, "\n"  # no word has a line feed
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Classes of frequency per doubling of a count, by which the head is chosen.
_STEPS = 16
#: Contexts that are normalised by one matrix product.
_ROWS = 1024


def held_out(doc_id: Column) -> Column:
    """CRC-32 of the id as text leaves 2 when divided by 7; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()
    for batch in batches:
        for piece in pieces(batch["text"]):
            for text in piece:
                held.update(words(text))
            held[END_WORD.encode()] += len(piece)
            if len(held) >= HELD_WORDS:
                yield _count_rows(held)
                held = Counter()
    yield _count_rows(held)


def _count_rows(held: Counter) -> pa.RecordBatch:
    columns = [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n"])


def token_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` of all tokens of ``text``; tasks add up their own before they are shuffled."""
    partial = docs.select("text").mapInArrow(_counted, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words by count, and the totals of all."""

    head: list[bytes]
    counts: np.ndarray
    least: int  # every word with this count or more is in the head, unless it is too long
    tokens: int
    distinct: int
    ends: int
    bin_tokens: np.ndarray | None = None  # per bin of rare words: tokens, and different words
    bin_words: np.ndarray | None = None

    @property
    def classes(self) -> int:
        return 2 + min(len(self.head), CLASS_WORDS)

    @property
    def rare(self) -> int:
        return self.classes - 1

    def class_counts(self) -> np.ndarray:
        """Tokens per class: ends, words with a class of their own, rare words."""
        own = self.counts[: self.classes - 2]
        return np.concatenate([[self.ends], own, [self.tokens - self.ends - own.sum()]])

    @property
    def bins(self) -> int:
        return len(self.bin_tokens)

    @property
    def bin_totals(self) -> np.ndarray:
        """Tokens and words of every bin, and one word that is not known."""
        return self.bin_tokens + self.bin_words + 1.0


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The totals of ``counts``, and as many frequent words as ``HEAD_WORDS`` allows.

    A histogram over classes of frequency, a few hundred rows, tells the least count, so only the words
    with a class of their own are ranked, and only if the head has too few of them.
    """
    totals = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == END_WORD, F.col("c")))).first()
    step = F.floor(F.log2("c") * _STEPS)
    least, room = None, HEAD_WORDS
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True):
        room -= row.n
        if room < 0:
            break
        least = row.c
    head = [] if least is None else counts.where(_in_head(least) & (F.col("word") != END_WORD)).collect()
    if len(head) < CLASS_WORDS:
        short = counts.where(_in_head(0) & (F.col("word") != END_WORD))
        head += short.where(~_in_head(least or 1 << 62)).orderBy(F.desc("c"), "word").limit(CLASS_WORDS - len(head)).collect()
    head = sorted(((r.word.encode(), r.c) for r in head), key=lambda x: (-x[1], x[0]))
    found = Vocabulary(
        [w for w, _ in head], np.array([c for _, c in head], np.int64), least or 1 << 62,
        totals[0] or 0, totals[1], totals[2] or 0,
    )
    own = found.classes - 2
    n = max(1, round(BIN_SHARE * math.sqrt(max(0, found.distinct - own))))
    found.bin_tokens, found.bin_words = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = (F.crc32(F.col("word").cast("binary")) % n).alias("at")
    for r in counts.where(F.col("word") != END_WORD).groupBy(at).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        found.bin_tokens[r["at"]], found.bin_words[r["at"]] = r.c, r.n
    for word, c in zip(found.head[:own], found.counts[:own].tolist(), strict=True):
        found.bin_tokens[zlib.crc32(word) % n] -= c
        found.bin_words[zlib.crc32(word) % n] -= 1
    return found


def _in_head(least: int) -> Column:
    return (F.col("c") >= least) & (F.octet_length("word") <= HEAD_BYTES)


class Reader:
    """Texts as places in the head, and as classes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.place = {w: i for i, w in enumerate(vocabulary.head)}
        own = vocabulary.rare - 1
        # By place, and at the end, for words outside the head, none.
        self.head_classes = np.array(
            [*range(1, own + 1), *(vocabulary.rare + zlib.crc32(w) % vocabulary.bins for w in vocabulary.head[own:]), -1], np.int64
        )

    def places(self, found: list[bytes]) -> np.ndarray:
        """Place of every word in the head, -1 outside."""
        return np.fromiter(map(self.place.get, found, repeat(-1)), np.int64, len(found))

    def classes(self, found: list[bytes], places: np.ndarray) -> np.ndarray:
        """Class of every word, then of the end; a rare word has the rare class plus its bin."""
        rare, bins = self.vocabulary.rare, self.vocabulary.bins
        out = np.append(self.head_classes[places], END)
        outside = np.flatnonzero(places < 0)
        out[outside] = [rare + zlib.crc32(found[i]) % bins for i in outside.tolist()]
        return out


class LogBilinear:
    """Parameters of the model, its training and its scores."""

    def __init__(self, class_counts: np.ndarray, dimensions: int = DIMENSIONS, contexts: int | None = None, kind=np.float64, per: int | None = None):
        self.per = per
        smoothed = class_counts + 1.0
        self.noise = np.log(smoothed / smoothed.sum()).astype(kind)
        rng = np.random.default_rng(SEED)
        n = len(class_counts)
        self.context = rng.normal(0, 0.1, (contexts or n, dimensions)).astype(kind)
        self.target = rng.normal(0, 0.1, (n, dimensions)).astype(kind)
        self.position = np.ones((2, dimensions), kind)
        self.bias = self.noise.copy()
        self.squares = [np.full_like(p, 1e-2) for p in self.parameters]
        self.norms = None if contexts else np.full((n, n), np.nan)  # of contexts that were seen

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.position, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return _weighted(self._around(first, second), self.position)

    def _around(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Vectors of both context words of every token."""
        return self.context.take(np.concatenate([first, second]), axis=0).reshape(2, len(first), -1)

    def step(self, first: np.ndarray, second: np.ndarray, token: np.ndarray, rng: np.random.Generator) -> None:
        """One step of AdaGrad on the noise-contrastive objective; all tokens share the noise."""
        n = len(self.bias)
        noise = np.searchsorted(self._cumulated(), rng.random(NOISE)).clip(0, n - 1)
        shift = math.log(NOISE)
        around = self._around(first, second)
        q = _weighted(around, self.position)
        truth, drawn = self.target.take(token, axis=0), self.target[noise]
        true = _sigmoid(-(np.einsum("td,td->t", q, truth) + self.bias[token] - self.noise[token] - shift))
        false = -_sigmoid(q @ drawn.T + (self.bias[noise] - self.noise[noise] - shift))
        dq = true[:, None] * truth + false @ drawn
        self._move(
            first, second, around, dq, np.concatenate([token, noise]), np.concatenate([true[:, None] * q, false.T @ q]),
            np.concatenate([true, false.sum(0)]),
        )

    def _move(self, first, second, around, dq, rows, d_target, d_bias) -> None:
        """Move what the tokens of a step touch, along gradients of the predictions and of ``rows`` of targets and biases."""
        per = self.per or len(first)
        order, rows, starts = _runs(rows)
        self._move_contexts(first, second, around, dq)
        self._rise(self.target, self.squares[1], rows, np.add.reduceat(d_target.take(order, axis=0), starts, axis=0) / per)
        self._rise(self.bias, self.squares[3], rows, np.add.reduceat(d_bias[order], starts) / per)

    def _move_contexts(self, first, second, around, dq) -> None:
        per = self.per or len(first)
        d_position = np.einsum("ptd,td->pd", around, dq)
        order, rows, starts = _runs(np.concatenate([first, second]))
        d_context = np.add.reduceat(np.concatenate([dq * p for p in self.position]).take(order, axis=0), starts, axis=0)
        self._rise(self.position, self.squares[2], slice(None), d_position / per)
        self._rise(self.context, self.squares[0], rows, d_context / per)

    @staticmethod
    def _rise(values, squares, rows, d) -> None:
        square = squares[rows] + d * d
        squares[rows] = square
        values[rows] += RATE * d / np.sqrt(square)

    def _cumulated(self) -> np.ndarray:
        if not hasattr(self, "_cdf"):
            self._cdf = np.cumsum(np.exp(self.noise), dtype=np.float64)
        return self._cdf

    def log_probability(self, first: np.ndarray, second: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural logarithm of the normalised probability of every token in its context."""
        n = len(self.bias)
        if self.norms is None:
            return self._each(first, second, token)
        pairs = np.flatnonzero(np.bincount(first * n + second, minlength=n * n))
        pairs = pairs[np.isnan(self.norms.ravel()[pairs])]
        for start in range(0, len(pairs), _ROWS):
            a, b = np.divmod(pairs[start : start + _ROWS], n)
            scores = self.predicted(a, b) @ self.target.T
            scores += self.bias
            most = scores.max(axis=1)
            scores -= most[:, None]
            self.norms[a, b] = most + np.log(np.exp(scores, out=scores).sum(axis=1, dtype=np.float64))
        score = np.einsum("td,td->t", self.predicted(first, second), self.target.take(token, axis=0)) + self.bias[token]
        return score - self.norms.ravel().take(first * n + second)

    def _each(self, first: np.ndarray, second: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The same token by token: there are too many contexts to keep their sums."""
        out = np.zeros(len(token))
        target, bias = self.target.T.astype(np.float32), self.bias.astype(np.float32)
        for start in range(0, len(token), _ROWS):
            part = slice(start, start + _ROWS)
            scores = self.predicted(first[part], second[part]).astype(np.float32, copy=False) @ target
            scores += bias
            scores -= scores.max(axis=1, keepdims=True)
            own = scores[np.arange(len(scores)), token[part]]
            out[part] = own - np.log(np.exp(scores, out=scores).sum(axis=1, dtype=np.float64))
        return out


class Members(LogBilinear):
    """The bin of a rare word among the ``size`` bins of its group."""

    def __init__(self, bin_counts: np.ndarray, size: int, contexts: int):
        super().__init__(bin_counts, contexts=contexts, kind=np.float32, per=RARE_PER)
        n = len(bin_counts)
        self.size, self.start = size, np.arange(n) // size * size
        self.width = np.minimum(size, n - self.start)
        totals = np.bincount(np.arange(n) // size, np.exp(self.noise))
        self.bias -= np.log(totals)[np.arange(n) // size].astype(np.float32)

    def _by_group(self, token: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
        """Places of the tokens of each group, and its bins."""
        order = np.argsort(self.start[token], kind="stable")
        starts = self.start[token[order]]
        ends = np.flatnonzero(np.append(starts[1:] != starts[:-1], True)) + 1 if len(order) else []
        at = 0
        for end in ends:
            start = starts[at]
            yield order[at:end], slice(start, start + self.width[start])
            at = end

    def step(self, first: np.ndarray, second: np.ndarray, token: np.ndarray, rng: np.random.Generator) -> None:
        """One step as for all classes; the noise is every bin of the token's group once, so nothing has to be drawn."""
        per, around = self.per or len(token), self._around(first, second)
        q = _weighted(around, self.position)
        dq = np.empty_like(q)
        for mine, group in self._by_group(token):
            here, target = q.take(mine, axis=0), self.target[group]
            slopes = -_sigmoid(here @ target.T + self.bias[group])
            # A true token counts as such, and once more as a part of the noise.
            own = token[mine] - group.start
            slopes[np.arange(len(mine)), own] += 1 + slopes[np.arange(len(mine)), own]
            dq[mine] = slopes @ target
            self._rise(self.target, self.squares[1], group, slopes.T @ here / per)
            self._rise(self.bias, self.squares[3], group, slopes.sum(0) / per)
        self._move_contexts(first, second, around, dq)

    def log_probability(self, first: np.ndarray, second: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of every token in its group, a group at a time."""
        out = np.zeros(len(token))
        for mine, group in self._by_group(token):
            scores = self.predicted(first.take(mine), second.take(mine)) @ self.target[group].T
            scores += self.bias[group]
            scores -= scores.max(axis=1, keepdims=True)
            own = scores[np.arange(len(mine)), token.take(mine) - group.start]
            out[mine] = own - np.log(np.exp(scores, out=scores).sum(axis=1, dtype=np.float64))
        return out


class Model:
    """The model of classes, and those of the groups and bins of rare words."""

    def __init__(self, vocabulary: Vocabulary):
        self.rare, bins = vocabulary.rare, vocabulary.bins
        self.size = max(1, math.ceil(math.sqrt(bins)))
        self.classes = LogBilinear(vocabulary.class_counts(), kind=np.float32, per=PER)
        groups = np.bincount(np.arange(bins) // self.size, vocabulary.bin_tokens)
        self.groups = LogBilinear(groups, contexts=self.rare + bins, kind=np.float32, per=RARE_PER)
        self.bins = Members(vocabulary.bin_tokens, self.size, self.rare + bins)
        self.spread = np.log(vocabulary.bin_totals)

    @property
    def models(self) -> list[LogBilinear]:
        return [self.classes, self.groups, self.bins]

    def flat(self) -> np.ndarray:
        return np.concatenate([m.flat() for m in self.models])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for m in self.models:
            size = len(m.flat())
            m.load(flat[at : at + size])
            at += size

    def _split(self, texts: list[np.ndarray]) -> tuple[tuple, tuple, np.ndarray]:
        """Contexts and tokens as classes; those of rare tokens as classes and bins, and which tokens these are."""
        fine = contexts(texts)
        at = np.flatnonzero(fine[2] >= self.rare)
        first, second, token = (c[at] for c in fine)
        return tuple(np.minimum(c, self.rare) for c in fine), (first, second, token - self.rare), at

    def learn(self, texts: list[np.ndarray], rng: np.random.Generator) -> int:
        coarse, fine, _ = self._split(texts)
        grouped = (*fine[:2], fine[2] // self.size)
        for model, columns, batch in ((self.classes, coarse, BATCH), (self.groups, grouped, RARE_BATCH), (self.bins, fine, RARE_BATCH)):
            for start in range(0, len(columns[0]), batch):
                model.step(*(c[start : start + batch] for c in columns), rng)
        return len(coarse[0])

    def log_probability(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm per token; of a rare one without its smoothed count, which is a factor."""
        coarse, fine, at = self._split(texts)
        out = self.classes.log_probability(*coarse)
        out[at] += self.groups.log_probability(*fine[:2], fine[2] // self.size)
        out[at] += self.bins.log_probability(*fine) - self.spread[fine[2]]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(0.5 * x)
    x *= 0.5
    x += 0.5
    return x


def _weighted(around: np.ndarray, position: np.ndarray) -> np.ndarray:
    """What the context words of every token predict together."""
    q = around[0] * position[0]
    q += around[1] * position[1]
    return q


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal rows together, the different rows, and where each starts in it."""
    order = np.argsort(rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return order, rows[starts], starts


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of texts, given as classes: the class two before, one before, and their own. A text starts after ends."""
    token = np.concatenate(texts)
    start = np.cumsum([0, *map(len, texts[:-1])])
    second = np.roll(token, 1)
    first = np.roll(token, 2)
    second[start] = first[start] = END
    following = start + 1
    following = following[following < np.append(start[1:], len(token))]
    first[following] = END
    return first, second, token


def train(docs: DataFrame, shared) -> np.ndarray:
    """Parameters of the model over all ``docs``.

    Every task trains on its texts from the same start, and the results are averaged by their tokens.
    A task sends one row per parameter: some 35,000 for the classes, twice 16,000 for those as contexts, and 50 more per bin.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = Model(shared.value), _reader(shared)
        rng, trained, held, size = np.random.default_rng(SEED), 0, [], 0
        for batch in batches:
            for piece in pieces(batch["text"]):
                for text in piece:
                    found = words(text)
                    held.append(reader.classes(found, reader.places(found)))
                    size += len(held[-1])
                    if size >= HELD_TOKENS:
                        trained += model.learn(held, rng)
                        held, size = [], 0
        if held:
            trained += model.learn(held, rng)
        if trained:
            flat = model.flat()
            columns = [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * trained), pa.array(np.full(len(flat), trained, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["at", "value", "tokens"])

    parts = docs.select("text").mapInArrow(fit, "at int, value double, tokens long")
    means = parts.groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value")).toArrow()
    flat = Model(shared.value).flat()
    flat[means["at"].to_numpy()] = means["value"].to_numpy()
    return flat


_readers: dict[int, Reader] = {}


def _reader(shared) -> Reader:
    """The reader of a broadcast vocabulary, made once per worker process."""
    if shared.value.tokens not in _readers or _readers[shared.value.tokens].vocabulary is not shared.value:
        _readers.clear()
        _readers[shared.value.tokens] = Reader(shared.value)
    return _readers[shared.value.tokens]


_scorers: list[tuple[np.ndarray, Model]] = []


def _scorer(shared, parameters) -> Model:
    """The trained model of a worker process; the tasks of the process share the sums over contexts that it keeps."""
    if not _scorers or _scorers[0][0] is not parameters.value:
        model = Model(shared.value)
        model.load(parameters.value)
        _scorers[:] = [(parameters.value, model)]
    return _scorers[0][1]


_SCORED = "doc_id {id}, row long, n_tokens long, known long, base double, rare double, model double, tail array<struct<word:string,n:long>>"
_TAIL = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))


def _scores(docs: DataFrame, shared, flat: np.ndarray) -> DataFrame:
    """Per ``row`` what its words in the head give: tokens known, sums of log10(c + 1), the model's log10, and the other words."""
    parameters = docs.sparkSession.sparkContext.broadcast(flat)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = _reader(shared), _scorer(shared, parameters)
        v = reader.vocabulary
        logs = np.log10(np.append(v.counts, 0) + 1.0)
        end = np.log10(v.ends + 1.0)
        for batch in batches:
            rows, ids, at = batch["row"].to_pylist(), batch["doc_id"], 0
            for piece in pieces(batch["text"]):
                found = [words(text) for text in piece]
                places = [reader.places(w) for w in found]
                texts = [reader.classes(w, p) for w, p in zip(found, places, strict=True)]
                starts = np.cumsum([0, *map(len, texts[:-1])])
                model_log = np.add.reduceat(model.log_probability(texts), starts) / np.log(10)
                out = []
                for row, w, p, t, m in zip(rows[at : at + len(piece)], found, places, texts, model_log.tolist(), strict=True):
                    head, rare = p >= 0, t[:-1] >= v.rare
                    tail = Counter([w[i] for i in np.flatnonzero(~head).tolist()])
                    out.append((
                        row, len(w) + 1, int(head.sum()) + (v.ends > 0), float(logs[p[head]].sum()) + end,
                        float(logs[p[head & rare]].sum()), m,
                        [{"word": word.decode(), "n": n} for word, n in tail.items()],
                    ))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), _TAIL]
                names = ["doc_id", "row", "n_tokens", "known", "base", "rare", "model", "tail"]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(piece)), *columns], names)
                at += len(piece)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(score, _SCORED.format(id=kind))


def score(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null text is empty and has its end as only token. A null id is not held out. If nothing can be
    learnt, every token is unknown: all counts are 0, and the model has two classes of equal weight and one bin. Rows that
    repeat are scored each; other columns are not read. Texts are read three times and not shuffled;
    shuffled are counts of words, and, of every document, its words outside the head.
    """
    taught = docs.where(~held_out(F.col("doc_id")))
    counts = stored(token_counts(taught), "counts")
    known = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    flat = train(taught, shared)
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    # The row number depends on how files are dealt to tasks, so number and result are kept together.
    scored = stored(_scores(numbered, shared, flat), "scores")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    met = lookup_join(tail, counts.where(~_in_head(known.least)), ["word"])
    found = met.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    both = scored.drop("tail").join(found, "row", "left").withColumns({
        "more": F.coalesce("more", F.lit(0)), "logs": F.coalesce("logs", F.lit(0.0)),
    })
    whole = float(known.tokens + known.distinct + 1)
    rare = F.col("rare") + F.col("logs")
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(whole)))).alias("base_score"),
        (F.col("model") + rare).alias("score"),
    )
