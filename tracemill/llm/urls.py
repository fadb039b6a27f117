"""URL filters as one bit-parallel automaton over all wildcard rules.

All rules are packed next to each other into words of 64 bits, one bit per state. A text is read byte
by byte, and a step moves all rules of all texts of a batch at once: a state passes on to the next if
the byte is the one that is waited for, and stays if a wildcard stands behind it. Bits that leave a
word enter the next one, so a rule may lie across words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import per_text

ALLOW, BLOCK = "allow", "block"

#: Symbols of a rule besides bytes: any byte but a slash; any run without a slash; any run.
ONE, RUN, ANY = "one", "run", "any"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of a path on it."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def symbols(self) -> list:
        """Over a canonical URL, which is a dot, the host and the path."""
        return [RUN, *f".{self.host}{self.path}".encode(), ANY]


#: The rules that are asked for, hosts and the starts of their paths.
RULES = (
    Rule("net", "/", BLOCK),
    Rule("example.net", "/en/", ALLOW),
    Rule("example.com", "/de/", BLOCK),
    Rule("org", "/fr/", ALLOW),
)


def glob_symbols(glob: str) -> list:
    """Symbols of a wildcard text: ``?`` one byte and ``*`` a run, both without a slash, ``**`` any run, ``\\`` quotes."""
    symbols, at, data = [], 0, glob.encode()
    while at < len(data):
        byte = data[at : at + 1]
        if byte == b"\\" and at + 1 < len(data):
            symbols.append(data[at + 1])
            at += 1
        elif byte == b"*":
            double = data[at + 1 : at + 2] == b"*"
            symbols.append(ANY if double else RUN)
            at += double
        else:
            symbols.append(ONE if byte == b"?" else data[at])
        at += 1
    return symbols


class Automaton:
    """Shift-And over whole texts for several lists of symbols."""

    def __init__(self, rules: Sequence[list]):
        waits = [[s for s in rule if s not in (RUN, ANY)] for rule in rules]
        starts = np.cumsum([0, *[len(w) + 1 for w in waits]])
        self.width = max(1, -(-int(starts[-1]) // 64))
        moves, stays = (np.zeros((256, 64 * self.width), bool) for _ in range(2))
        self.first = self._packed([int(s) for s in starts[:-1]])
        slash = ord("/")
        for rule, state in zip(rules, starts[:-1].tolist(), strict=True):
            for symbol in rule:
                if symbol == ANY:
                    stays[:, state] = True
                elif symbol == RUN:
                    stays[:slash, state] = stays[slash + 1 :, state] = True
                else:
                    state += 1
                    if symbol == ONE:
                        moves[:slash, state] = moves[slash + 1 :, state] = True
                    else:
                        moves[symbol, state] = True
        self.moves, self.stays = self._words(moves), self._words(stays)
        self.last = [int(s) + len(w) for s, w in zip(starts[:-1], waits, strict=True)]

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8")

    def _packed(self, states: list[int]) -> np.ndarray:
        bits = np.zeros(64 * self.width, bool)
        bits[states] = True
        return self._words(bits)

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Whether each text, as a whole, is matched by each rule."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        state = np.tile(self.first, (len(texts), 1))
        running, one, top = len(texts), np.uint64(1), np.uint64(63)
        for at in range(int(lengths[0]) if len(texts) else 0):
            while lengths[running - 1] <= at:  # longer texts come first
                running -= 1
            now, byte = state[:running], data[begins[:running] + at]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:running] = (shifted & self.moves[byte]) | (now & self.stays[byte])
        found = np.zeros((len(texts), len(self.last)), bool)
        for column, last in enumerate(self.last):
            found[order, column] = state[:, last // 64] >> np.uint64(last % 64) & one != 0
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host, its A-Z in lower case, and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def _judged(urls: list[str | None], rules: Sequence[Rule], automaton: Automaton, default: str) -> list[tuple]:
    parts = [split_url(url) for url in urls]
    found = automaton.matches([f".{host}{path}".encode() for host, path in parts])
    rows = []
    for (host, path), hits in zip(parts, found, strict=True):
        fitting = [rules[i] for i in np.flatnonzero(hits)]
        # The longest name wins, and of equal ones the first in the list.
        rule = max(fitting, key=lambda r: len(r.name), default=None)
        rows.append((host, path, rule.name if rule else None, rule.verdict if rule else default))
    return rows


_KIND = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judged(url: Column, rules: Sequence[Rule] = RULES, default: str = ALLOW) -> Column:
    """Struct ``host, path, rule, verdict`` of a URL column; without a rule that fits, ``default``."""
    rules = tuple(rules)
    automaton = Automaton([r.symbols() for r in rules])
    body = per_text(lambda urls: _judged(urls, rules, automaton, default), _KIND)
    return F.arrow_udf(body, "host string, path string, rule string, verdict string")(url)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = ALLOW) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict``.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and gets ``default``.
    Rows that repeat are judged each, other columns are not read, nothing is shuffled.
    """
    return pages.select("page_id", judged(F.col("url"), rules, default).alias("j")).select("page_id", "j.*")
