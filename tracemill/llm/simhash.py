"""SimHash near-duplicates, found by hashing balls that meet in the middle.

Two fingerprints that differ in at most ``2 r`` bits have a common value within ``r`` bits of either.
So every different fingerprint emits all values within ``r = 1`` bit, rows meet by value, and what
meets is linked after its distance is checked. A value is within one bit of 65 fingerprints, so no
group can be larger, however many documents are copies: those share a fingerprint and emit once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracemill.llm.common import free_name, stored
from tracemill.llm.components import connected_components
from tracemill.operators.joins import lookup_join

SHINGLE = 3
SEED = 42
BITS = 64
#: Fingerprints link at this many differing bits; every one emits what is within half of it.
RADIUS = 2

#: A-Z to a-z; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """SimHash of a text, eight bytes, most significant first; zero without a word."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return bytes(8)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digests = b"".join([xxhash.xxh64_digest(run, SEED) for run in map(b" ".join, runs)])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[start : start + BLOCK], axis=1)
        even = len(bits) // 255 * 255  # so many bits add up within a byte
        ones += bits[:even].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[even:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """Fingerprint of each text as a long that holds the 64 bits."""
    return pa.array([int.from_bytes(fingerprint(t.as_py()), "big", signed=True) for t in texts], pa.int64())


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all different fingerprints in ``bits`` within ``RADIUS`` bits.

    Per value that several fingerprints meet at, its members are linked with the smallest; all of
    them are within the radius of each other, and every link of theirs lies inside some value's
    group, so the components are those of all links.
    """
    own = F.col("bits")
    ball = F.array(own, *[own.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    met = prints.select("bits", F.explode(ball).alias("value")).repartition("value").sortWithinPartitions("value", "bits")
    return met.mapInArrow(_stars, "a long, b long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each member of a run of one value with the first member; runs may cross batches."""
    first = None  # value and first member of the run that is open
    for batch in batches:
        if not batch.num_rows:
            continue
        value, bits = batch["value"].to_numpy(), batch["bits"].to_numpy()
        opens = np.ones(len(value), bool)
        opens[1:] = value[1:] != value[:-1]
        if first is not None and first[0] == value[0]:
            opens[0] = False
        at = np.maximum.accumulate(np.where(opens, np.arange(len(value)), -1))
        head = np.where(at >= 0, bits[at], first[1] if first is not None else 0)
        first = (value[-1], head[-1])
        linked = ~opens & (np.bitwise_count((head ^ bits).view(np.uint64)) <= RADIUS)
        yield pa.RecordBatch.from_arrays([pa.array(head[linked]), pa.array(bits[linked])], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, fingerprint, component_id`` (smallest id reachable by links, itself included).

    A text without a word, or null, has fingerprint zero and links like any other. Rows that repeat
    an id are documents of their own. A null id is never the smallest: a component in which all are
    null has a null id. Other columns are not read. Texts are read once and not shuffled.
    """
    prints = stored(docs.select("doc_id", fingerprints("text").alias("bits")), "fingerprints")
    classes = _classes(prints)
    joined = lookup_join(prints, classes, ["bits"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(prints: DataFrame) -> DataFrame:
    """``(bits, component_id)``, one row per fingerprint."""
    least = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "classes")
    found = _linked(least)
    members = found.join(least, "bits")
    lowest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = lookup_join(found, lowest, ["component"]).select("bits", "component_id")
    return least.join(linked, "bits", "left").select("bits", F.coalesce("component_id", "least").alias("component_id"))


def _linked(prints: DataFrame) -> DataFrame:
    """``(bits, component)`` of the fingerprints that link with another; the component is one of them."""
    return connected_components(links(prints.select("bits"))).select(F.col("node").alias("bits"), "component")


def _row_hash(docs: DataFrame) -> Column:
    """128 bits of all columns of a row, and of which of them are null."""
    columns = [c for name in docs.columns for c in (docs[name], docs[name].isNull())]
    return F.struct(*[F.xxhash64(F.lit(seed), *columns).alias(f"h{seed}") for seed in (1, 2)])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of every component.

    It is that with the smallest id, a null id last; among rows with that id, that of the smallest hash of all
    columns. So rows that repeat an id in two components both stay, copies without an id leave one, and of rows
    that are equal in every column one stays. Every text that goes has a copy, or a near copy linked to it, that stays.
    """
    name = free_name(docs, "row_hash")
    prints = stored(docs.select("doc_id", fingerprints("text").alias("bits"), _row_hash(docs).alias("row")), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    best = stored(prints.groupBy("bits").agg(F.min(first).alias("best")), "classes")
    joined = best.join(_linked(best), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    kept = joined.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias(name))
    return docs.withColumn(name, _row_hash(docs)).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
