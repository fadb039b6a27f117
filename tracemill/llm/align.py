"""Alignment of the tokens of two tokenizers over the same texts.

Both token sequences of a text are arrays of byte offsets at which tokens end. Where both have an end, a group ends.
As long as tokens pair one to one, the arrays are equal at the current shift between their indices:
slices of doubling length are compared there until one differs, then shorter ones, and the whole
stretch is jumped. What follows is an irregular group, which is walked token by token to the next common end; it
sets a new shift.

Two tokens are linked where they share a group. How many documents link a pair of ids is counted over
the corpus, and tells which links of a document are the best of their first id.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.llm.common import pieces, stored
from tracemill.operators.joins import lookup_join

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"  # how pieces write a space
#: Pairs that are broadcast with their counts, at most, 16 bytes each; all others meet their counts in a join.
HEAD_PAIRS = 1 << 20
#: Pairs that a task gathers before it adds them up.
HELD_PAIRS = 1 << 21
#: Classes of frequency per doubling of a count, by which the head is chosen.
_STEPS = 16
#: Groups of more links than this are linked by different ids.
_MANY = 64
#: Words whose ids a worker keeps, and their length, at most.
KEPT, LONGEST = 300_000, 64
_ID = (1 << 21) - 1


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, others follow 255."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the alignment of a text."""

    def __init__(self, first: bytes, second: bytes):
        self.first = tokenizers.Tokenizer.from_str(first.decode())
        self.first.encode_special_tokens = True  # their strings in a text are ordinary text
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        alphabet = byte_alphabet()
        vocabulary = self.first.get_vocab()
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.first_bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.second_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.first_sizes = np.array([len(b) for b in self.first_bytes], np.int64)
        self.second_sizes = np.array([len(b) for b in self.second_bytes], np.int64)
        self.strings = separated(max(len(self.first_sizes), len(self.second_sizes)))
        pieces_ = [self.second.id_to_piece(i) for i in range(len(self.second_bytes))]
        #: Whether pieces hold spaces at their start only and no line feed, so that words are encoded apart.
        self.apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces_)
        self.before_line = len(self.second.encode("\n")) - 1  # pieces put before a text that starts with a line feed
        self.kept: dict[str, bytes | None] = {"": None}
        self.ranked = self._ranked(json.loads(first))

    def _ranked(self, content: dict) -> tiktoken.Encoding | None:
        """The first vocabulary as ranks, where its merges stand in the order of their ids and the words are cut the usual way."""
        cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        known, split = content["model"]["vocab"], content.get("pre_tokenizer") or {}
        merged = [known["".join(m if isinstance(m, list) else m.split(" "))] for m in content["model"]["merges"]]
        usual = content.get("normalizer") is None and {k: split.get(k, v) for k, v in cut.items()} == cut
        if not usual or merged != sorted(merged) or (merged and merged[0] < 256):
            return None
        special = {t["id"] for t in content.get("added_tokens", [])}
        ranks = {self.first_bytes[i]: i for i in known.values() if i not in special}
        return tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.second.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both for each text with a space before it, as 32-bit integers; none where the bytes of either differ from it."""
        out = []
        units = [self._units(t) for t in texts]
        self._learn(list({u: None for found in units for u in found if u not in self.kept}))
        for text, found in zip(texts, units, strict=True):
            one = self._first(" " + text) if text else b""
            two = list(map(self.kept.__getitem__, found)) if one else [b""]
            joined = self._second([text], [" " + text])[0] if None in two else b"".join(two)
            out.append((one, joined) if one and joined else (b"", b""))
        if len(self.kept) > KEPT:
            self.kept = {"": None}
        return out

    def _first(self, text: str) -> bytes:
        if self.ranked is None:
            ids = self.first.encode(text, add_special_tokens=False).ids
            same = b"".join(map(self.first_bytes.__getitem__, ids)) == text.encode()
        else:
            ids = self.ranked.encode_ordinary(text)
            same = self.ranked.decode_bytes(ids) == text.encode()
        return array("I", ids).tobytes() if same else b""

    def _second(self, texts: list[str], wholes: list[str], skip: int = 0) -> list[bytes]:
        """Ids of each text without the first ``skip``; none where their bytes are not those of its whole."""
        out = []
        for ids, whole in zip(self.second.encode(texts, num_threads=1) if texts else [], wholes, strict=True):
            ids = ids[skip:]
            same = b"".join(map(self.second_bytes.__getitem__, ids)) == whole.encode()
            out.append(array("I", ids).tobytes() if same else b"")
        return out

    def _units(self, text: str) -> list[str]:
        """Words that are encoded apart by the second: each with the space before it, which is left out here, or the line feed.

        Where white space is single spaces and line feeds, all of them between words, no piece goes
        across the place before one. Any other text is one unit, which is not kept.
        """
        words = text.split()
        if not self.apart or words != text.replace("\n", " ").split(" ") or len(max(words, key=len, default="")) > LONGEST:
            return [""]
        return text.replace("\n", " \n").split(" ")

    def _learn(self, new: list[str]) -> None:
        """Ids of new units; None for one whose bytes change."""
        spaced, lines = [u for u in new if u[0] != "\n"], [u for u in new if u[0] == "\n"]
        found = self._second(spaced, [" " + u for u in spaced]) + self._second(lines, lines, self.before_line)
        self.kept.update(zip(spaced + lines, (ids or None for ids in found), strict=True))


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the increasing arrays have a value in common: indices after it in ``a`` and ``b``, which end alike."""
    x, y, n, m, i, j = a.tolist(), b.tolist(), len(a), len(b), 0, 0
    starts, shifts, lengths = array("q"), array("q"), array("q")
    while i < n and j < m:
        u, v = x[i], y[j]
        while u != v:  # an irregular group, up to the next common end
            if u < v:
                i += 1
                u = x[i]
            else:
                j += 1
                v = y[j]
        # Equal at this shift: jump as far as doubled steps stay equal, then halve them.
        start, shift = i, j - i
        i += 1
        j += 1
        if i < n and j < m and x[i] == y[j]:
            step = 1
            while i + step <= n and x[i : i + step] == y[j : j + step]:
                i += step
                j += step
                step *= 2
            while step > 1:
                step //= 2
                if i + step <= n and x[i : i + step] == y[j : j + step]:
                    i += step
                    j += step
        starts.append(start)
        shifts.append(shift)
        lengths.append(i - start)
    starts, shifts, lengths = (np.array(c, np.int64) for c in (starts, shifts, lengths))
    before = np.cumsum(lengths) - lengths
    left = np.arange(lengths.sum()) + np.repeat(starts + 1 - before, lengths)
    return left, left + np.repeat(shifts, lengths)


@dataclass
class Aligned:
    """Tokens of several texts, one after the other, and the groups they share."""

    a: np.ndarray
    b: np.ndarray
    left: np.ndarray  # index after the last token of each group
    right: np.ndarray
    ends: np.ndarray  # groups up to the end of each text

    @staticmethod
    def of(aligner: Aligner, ids: list[tuple[bytes, bytes]]) -> Aligned:
        """Both sequences of every text span the same bytes, so a text ends where a group ends."""
        a, b = (np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in zip(*ids, strict=True))
        left, right = common_ends(np.cumsum(aligner.first_sizes[a]), np.cumsum(aligner.second_sizes[b]))
        upto = np.cumsum([len(x) // 4 for x, _ in ids])
        return Aligned(a, b, left, right, np.searchsorted(left, upto, side="right"))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair as ``a << 32 | b`` and number of links of the different linked pairs of each text, in order."""
        l, r = np.diff(self.left, prepend=0), np.diff(self.right, prepend=0)
        text = np.searchsorted(self.ends, np.arange(len(l)), side="right")
        single = (l == 1) & (r == 1)
        first, second, owner = [self.a[self.left[single] - 1]], [self.b[self.right[single] - 1]], [text[single]]
        times = [np.ones(len(first[0]), np.int64)]
        small = np.flatnonzero(~single & (l * r <= _MANY))
        if len(small):  # every index of the group in ``a`` with every one in ``b``
            n = (l * r)[small]
            at, wide = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(r[small], n)
            first.append(self.a[np.repeat((self.left - l)[small], n) + at // wide])
            second.append(self.b[np.repeat((self.right - r)[small], n) + at % wide])
            owner.append(np.repeat(text[small], n))
            times.append(np.ones(len(at), np.int64))
        for g in np.flatnonzero(~single & (l * r > _MANY)).tolist():  # different ids with different ids
            ids_a, times_a = np.unique(self.a[self.left[g] - l[g] : self.left[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.right[g] - r[g] : self.right[g]], return_counts=True)
            first.append(np.repeat(ids_a, len(ids_b)))
            second.append(np.tile(ids_b, len(ids_a)))
            owner.append(np.full(len(first[-1]), text[g]))
            times.append((times_a[:, None] * times_b).ravel())
        first, second, owner, times = (np.concatenate(c) for c in (first, second, owner, times))
        # One number to sort by: texts of a piece are few, and ids less than 21 bits.
        key = owner << 42 | first << 21 | second
        if (times == 1).all():
            key = np.sort(key)
        else:
            order = np.argsort(key)
            key, times = key[order], times[order]
        opens = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, times = key[opens], np.add.reduceat(times, opens) if len(opens) else times
        return key >> 42, (key >> 21 & _ID) << 32 | key & _ID, times

    def told(self, strings: list[str]) -> list[str]:
        """Groups of each text as ``a1,a2|b1;a3|b2,b3``; ``strings`` are an id after each separator, see :func:`separated`."""
        l, r = np.diff(self.left, prepend=0), np.diff(self.right, prepend=0)
        starts_a, starts_b, size = self.left - l, self.right - r, len(strings) // 3
        index = np.empty(len(self.a) + len(self.b), np.int64)
        at_a = np.arange(len(self.a)) + np.repeat(starts_b, l)
        at_b = np.arange(len(self.b)) + np.repeat(self.left, r)
        index[at_a], index[at_b] = self.a, self.b  # after a comma
        index[at_a[starts_a]] += size  # after a semicolon
        index[at_b[starts_b]] += 2 * size  # after a bar
        parts = list(map(strings.__getitem__, index.tolist()))
        ends = [0, *np.where(self.ends > 0, np.append(0, self.left + self.right)[self.ends], 0).tolist()]
        return ["".join(parts[i:j])[1:] for i, j in zip(ends, ends[1:], strict=False)]


def separated(ids: int) -> list[str]:
    """Every id after a comma, after a semicolon and after a bar."""
    return [f"{separator}{i}" for separator in ",;|" for i in range(ids)]


@lru_cache(maxsize=2)
def _aligner(first: bytes, second: bytes) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Aligner(first, second)


def _shared(spark: SparkSession, first: str | None, second: str | None):
    """Both vocabulary files, about 4 MB, as the driver reads them: executors need not have them."""
    contents = []
    for path, name in ((first, FIRST), (second, SECOND)):
        with open(path or public_tokenizers.path(name), "rb") as file:
            contents.append(file.read())
    return spark.sparkContext.broadcast(tuple(contents))


_ALIGNED = "row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, shared) -> DataFrame:
    """Per row of ``docs`` (row, doc_id, text) its alignment, and its different pairs and how often each is linked, packed."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            at = 0
            for piece in pieces(batch["text"]):
                ids = aligner.encode([t or "" for t in piece])
                found = Aligned.of(aligner, ids)
                text, pairs, times = found.links()
                told, groups = found.told(aligner.strings), np.diff(found.ends, prepend=0).tolist()
                starts = np.searchsorted(text, np.arange(len(ids) + 1)).tolist()
                out = []
                for k, (first, second) in enumerate(ids):
                    mine = slice(starts[k], starts[k + 1])
                    sha = hashlib.sha256(told[k].encode()).hexdigest() if groups[k] else ""
                    out.append((len(first) // 4, len(second) // 4, groups[k], int(times[mine].sum()), sha, pairs[mine].tobytes(), _packed(times[mine])))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([batch["row"].slice(at, len(piece)), batch["doc_id"].slice(at, len(piece)), *columns], names)
                at += len(piece)

    return docs.mapInArrow(align, _ALIGNED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _packed(times: np.ndarray) -> bytes:
    """Most are one; a zero byte more says that all are four times as wide."""
    return times.astype(np.uint8).tobytes() if times.max(initial=0) < 256 else times.astype(np.uint64).tobytes() + b"\0"


def _unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(pairs, np.int64)
    wide = len(times) != len(codes)
    return codes, np.frombuffer(times[:-1], np.uint64).astype(np.int64) if wide else np.frombuffer(times, np.uint8).astype(np.int64)


def _documents_per_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for pairs in batch["pairs"]:
            held.append(np.frombuffer(pairs.as_buffer() or b"", np.int64))
            size += len(held[-1])
            if size >= HELD_PAIRS:
                codes, n = _added(held)
                held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["pair", "n"])
    if held:
        codes, n = _added(held)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["pair", "n"])


def _added(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.unique(np.concatenate(held), return_counts=True)
    return codes, n.astype(np.int64)


def pair_counts(alignments: DataFrame) -> DataFrame:
    """``pair, n, best``: how many documents link each pair, and whether no other second id has more with the first."""
    partial = alignments.select("pairs").mapInArrow(_documents_per_pair, "pair long, n long")
    counts = stored(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    first = F.shiftright("pair", 32)
    # One row per id of the first vocabulary, which has some 50,000.
    most = F.broadcast(counts.groupBy(first.alias("first")).agg(F.max("n").alias("most")))
    return counts.withColumn("first", first).join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least(counts: DataFrame) -> int:
    """A count that at most ``HEAD_PAIRS`` pairs reach, from a histogram of some hundred rows."""
    step = F.floor(F.log2("n") * _STEPS).alias("step")
    least, room = 1 << 62, HEAD_PAIRS
    for row in sorted(counts.groupBy(step).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).collect(), reverse=True):
        room -= row.pairs
        if room < 0:
            break
        least = row.n
    return least


_KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_SCORED = "best long, total long, tail array<struct<pair:long,times:long>>"
_TAIL = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))


def _scores(alignments: DataFrame, head) -> DataFrame:
    """``alignments`` with the links that are best and the sum of counts, over the pairs in the head, and the other pairs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = head.value
        for batch in batches:
            out = []
            for pairs, times in zip(batch["pairs"], batch["times"], strict=True):
                codes, links = _unpacked(pairs.as_py(), times.as_py())
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                met = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                here = at[met]
                tail = [{"pair": p, "times": t} for p, t in zip(codes[~met].tolist(), links[~met].tolist(), strict=True)]
                out.append((int(links[met][best[here]].sum()), int((links[met] * n[here]).sum()), tail))
            kinds = [pa.int64(), pa.int64(), _TAIL]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in _KEPT), *columns], [*_KEPT, "best", "total", "tail"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alignments.select(_KEPT).schema)
    return alignments.mapInArrow(score, f"{kept}, {_SCORED}")


def align(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; ``first`` and ``second`` are vocabulary files.

    A null or empty text, or one whose bytes either tokenizer changes, has no tokens: zeros and ''. Repeated rows are documents
    each, also in the counts; a null id stays null. Other columns are not read. Every text is encoded once; its packed pairs are written
    and read for the counts and for the sums. Pairs beyond the head are joined with their counts.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # The row number depends on how files are dealt to tasks, so number and result are kept together.
    alignments = stored(aligned(numbered, _shared(docs.sparkSession, first, second)), "aligned")
    counts = stored(pair_counts(alignments), "counts")
    least = _least(counts)
    frequent = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(frequent["pair"].to_numpy())
    head = docs.sparkSession.sparkContext.broadcast(tuple(frequent[c].to_numpy()[order] for c in ("pair", "n", "best")))
    scored = stored(_scores(alignments, head), "scores")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.pair", "t.times")
    met = lookup_join(tail, counts.where(F.col("n") < least), ["pair"])
    added = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.col("n")).alias("sum")
    )
    joined = scored.drop("tail").join(added, "row", "left")
    return joined.select(
        F.col("doc_id"), "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
