"""Byte-level BPE by monoid tree reduction.

The encoding of a byte string is built from the encodings of its halves. Two neighbours are joined by
encoding a window around their boundary anew: it starts with one token on either side and grows on
the side where it does not fit yet. A sequence of tokens is the encoding of its bytes exactly if every
two neighbours are the encoding of the bytes of both. So once the first and the last token of the
window fit the tokens outside, all tokens outside are final, and the join equals the encoding of
the whole. Joining is associative: any tree over the same bytes gives the same tokens.

Matches of the pattern are encoded separately, so across their borders the join is concatenation.
Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from array import array  # of unsigned 32-bit integers, little-endian where Spark runs
from collections.abc import Callable, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.llm.common import per_text

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Encodings of pairs, windows and halves that a worker keeps, and words after a space, twice as many; when full they start again.
KEPT = 300_000
#: Bytes of a window or a half that is short: kept, and merged by looking at all pairs in turn.
SHORT, NO_RANK = 16, 1 << 60
#: What is longer is encoded anew each time.
LONG_KEY = 64
#: A part of so many bytes is a leaf of the tree: it is merged as a whole.
LEAF_BYTES = 4
#: Parts that a leaf of the tree over a text joins at once.
LEAF = 1024

DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return parse_ranks(lines.read())


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class _Kept(dict):
    """Values of a function by key; emptied when it is full. Long keys are not kept, so the size is bounded."""

    def __init__(self, function: Callable, limit: int = KEPT):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        value = self.function(key)
        if len(key) > LONG_KEY:
            return value
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class TreeBpe:
    """Encoder and decoder over a vocabulary of byte strings by rank, where the rank is the id.

    Every single byte must be in the vocabulary, and every token must be the encoding of its bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.pairs = _Kept(self._pair)
        self.windows = _Kept(self._merge)
        self.halves = _Kept(self.encode_bytes)
        self.words = _Kept(self._word)
        self.spaced_words = _Kept(self._spaced, 2 * KEPT)
        self.line_feed = self._word("\n")

    def encode_bytes(self, data: bytes) -> list[int]:
        """Tokens of one match: of the whole if it is a token, else joined from its halves."""
        if not data:
            return []
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        if len(data) <= LEAF_BYTES:
            return self._merge(data)
        middle = len(data) // 2
        if middle > SHORT:
            return self.join(self.encode_bytes(data[:middle]), self.encode_bytes(data[middle:]))
        return self.join(self.halves[data[:middle]], self.halves[data[middle:]])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the bytes of ``left`` and ``right``, each of which is the encoding of its own bytes."""
        if not left or not right:
            return left + right
        pairs, before, after = self.pairs, 1, 1
        window = pairs[left[-1], right[0]]
        if window is None:
            return left + right
        while True:
            fits = True
            if before < len(left) and pairs[left[-before - 1], window[0]] is not None:
                before, fits = min(2 * before, len(left)), False
            if after < len(right) and pairs[window[-1], right[after]] is not None:
                after, fits = min(2 * after, len(right)), False
            if fits:
                return left[: len(left) - before] + window + right[after:]
            inside = [*left[len(left) - before :], *right[:after]]
            window = self.windows[b"".join(map(self.tokens.__getitem__, inside))]

    def _pair(self, pair: tuple[int, int]) -> list[int] | None:
        """None if the two tokens are the encoding of their bytes, else that encoding."""
        merged = self._merge(self.tokens[pair[0]] + self.tokens[pair[1]])
        return None if merged == [*pair] else merged

    def _merge(self, data: bytes) -> list[int]:
        """Tokens of a window: the pair of lowest rank, the leftmost of them, is merged until there is none."""
        ranks, n = self.ranks, len(data)
        if data in ranks:
            return [ranks[data]]
        if n <= SHORT:
            parts = [data[i : i + 1] for i in range(n)]
            found = [ranks.get(data[i : i + 2], NO_RANK) for i in range(n - 1)]
            while found and (least := min(found)) < NO_RANK:
                at = found.index(least)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del found[at]
                if at:
                    found[at - 1] = ranks.get(parts[at - 1] + parts[at], NO_RANK)
                if at < len(found):
                    found[at] = ranks.get(parts[at] + parts[at + 1], NO_RANK)
            return [ranks[part] for part in parts]
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i]
            if end[i] == 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
                k = end[after[j]]
                if (r := ranks.get(data[i:k])) is not None:
                    heappush(heap, (r, i, k))
            h = before[i]
            if h >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if end[i]]

    def _word(self, part: str) -> bytes:
        encode = self.encode_bytes
        return array("I", [t for match in self.split(part) for t in encode(match.encode())]).tobytes()

    def _spaced(self, word: str) -> bytes:
        return self._word(" " + word)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; none for null.

        A match takes one space before what it names and no white space after it. So where white space
        is single spaces and line feeds, all of them between words, no match crosses the place before
        one or the place after a line feed, and words with the space before them are encoded apart,
        each once as long as it is kept. Any other text is split as a whole.
        """
        if not text:
            return b""
        lines = text.split("\n")
        if text.split() != text.replace("\n", " ").split(" "):
            return _concatenate([self._word(text)])
        parts, first, spaced = [], self.words, self.spaced_words
        for line in lines:
            words = line.split(" ")
            parts.append(first[words[0]])
            parts += map(spaced.__getitem__, words[1:])
            parts.append(self.line_feed)
        parts.pop()
        return _concatenate(parts)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of a text from its ids."""
        return _concatenate(list(map(self.tokens.__getitem__, array("I", ids))))


def _concatenate(parts: Sequence[bytes]) -> bytes:
    """``parts``, concatenated up a tree of halves."""
    if len(parts) <= LEAF:
        return b"".join(parts)
    middle = len(parts) // 2
    return _concatenate(parts[:middle]) + _concatenate(parts[middle:])


@lru_cache(maxsize=2)
def _codec(content: bytes, pattern: str) -> TreeBpe:
    return TreeBpe(parse_ranks(content), pattern)


def _shared(spark: SparkSession, path: str | None):
    """The vocabulary file, about 1 MB, as the driver reads it: executors need not have it."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(spark: SparkSession, text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids of a text column as binary, four bytes each, little-endian; empty for null."""
    ranks = _shared(spark, path)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks.value, pattern)
        return pa.array([codec.encode(t.as_py()) for t in texts], pa.binary())

    return encode(text)


def decoded(spark: SparkSession, ids: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Bytes of a binary column of ids; empty for null."""
    ranks = _shared(spark, path)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        codec = _codec(ranks.value, pattern)
        return pa.array([codec.decode(i.as_py() or b"") for i in ids], pa.binary())

    return decode(ids)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of its whole text, encoded and decoded.

    A null text is empty: no tokens, and the digests of no bytes. A null id stays null, repeated
    rows give repeated results, other columns are not read. Nothing is shuffled; ids and bytes of
    one text at a time are held, and only their digests leave the task.
    """
    ranks = _shared(docs.sparkSession, path)

    def digests(texts: list[str | None]) -> list[tuple]:
        codec, rows = _codec(ranks.value, pattern), []
        for text in texts:
            ids = codec.encode(text)
            back = codec.decode(ids)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
        return rows

    digest = F.arrow_udf(per_text(digests, DIGEST), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", digest("text").alias("digest")).select("doc_id", "digest.*")
