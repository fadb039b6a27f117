"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learnt that turns centred vectors so that their signs lose as little as possible: the
signs are the code. Rotations learnt from different starts give as many bits as are needed. The code is
cut into parts, one per table; of vectors that share a part, those whose whole codes lie within a Hamming
radius are compared by their original values. How many bits a part has follows from the number of vectors;
how many parts there are, and the radius, from pairs at the threshold, made from sampled vectors: nearly
all of them share a part, and none is outside the radius. Only ids and codes are dealt to the tables; a
vector moves to a block where its code has a partner. Any number of vectors goes the same way.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tracemill.llm.common import stored
from tracemill.llm.components import connected_components
from tracemill.operators.joins import BROADCAST_BYTES, lookup_join

LEAST_COSINE = 0.93
#: Share of made pairs at the threshold that must meet in some table, and pairs made of either kind.
RECALL, PROBES = 0.99, 1000
#: Vectors per bucket that the bits of a part are chosen for, and tables, at most: with more, parts get shorter.
BUCKET, MOST_TABLES = 64, 128
#: Bits of a part, at least. Parts of so many get as many tables as pairs at the threshold need.
LEAST_BITS = 4
#: The Hamming radius is the largest distance of the made pairs, times this.
SLACK = 1.1
#: Numbers of dimensions with rotations of their own; vectors of rarer numbers get random rotations.
MOST_LEARNT = 1024
#: Vectors that the rotations are learnt from, about, at most, and the rounds of learning.
SAMPLE, ROUNDS = 10_000, 30
#: Fewer sampled vectors tell no mean: rotations are then random and nothing is centred.
LEAST_SAMPLE = 50
SEED = 20_110_620
#: Vectors of one bucket that are compared as one block; a larger bucket is split into pairs of blocks.
BLOCK = 256
_BLOCK_COLUMNS = ["label", "dimensions", "at", "key", "low", "high"]


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rotation of centred vectors (rows) whose signs are nearest to the rotated vectors.

    Codes and rotation are improved in turn: given the rotation the signs are best, and given the
    signs the best rotation comes from a singular value decomposition. The start is random.
    """
    dimensions = sample.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))[0]
    for _ in range(rounds if len(sample) else 0):
        signs = np.where(sample @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(sample.T @ signs)
        rotation = left @ right
    return rotation


@dataclass
class Tables:
    """How vectors of one number of dimensions are coded: ``tables`` parts of ``bits`` bits each, and the radius of whole codes."""

    mean: np.ndarray
    rotations: list[np.ndarray]
    bits: int
    tables: int
    radius: int

    @property
    def length(self) -> int:
        """Bits of a whole code: those of the parts, and no fewer than dimensions."""
        return max(self.bits * self.tables, len(self.mean))

    def code(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of vectors (of length 1), a column per bit."""
        return _code(vectors - self.mean, self.rotations)[:, : self.length]

    def parts(self, code: np.ndarray) -> np.ndarray:
        """The parts of codes as numbers, one column per table."""
        cut = code[:, : self.bits * self.tables].reshape(len(code), self.tables, self.bits)
        return cut @ (1 << np.arange(self.bits, dtype=np.int64))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        return self.parts(self.code(vectors))


def _code(centred: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([centred @ r >= 0 for r in rotations], axis=1)


def probes(sample: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors with the cosine ``least``: from sampled vectors in any direction, and in those in which they differ."""
    rng = np.random.default_rng(SEED)
    draw = lambda: sample[rng.integers(0, len(sample), PROBES)]
    made = []
    for away in (rng.normal(size=(PROBES, sample.shape[1])), draw() - draw()):
        a = draw()
        away = away - (away * a).sum(1, keepdims=True) * a
        length = np.linalg.norm(away, axis=1, keepdims=True)
        apart = length[:, 0] > 1e-6
        if apart.any():
            a, away = a[apart], away[apart] / length[apart]
            made.append((a, least * a + math.sqrt(max(0.0, 1 - least * least)) * away))
    return made


def choose_tables(sample: np.ndarray, dimensions: int, most: int, least: float) -> Tables:
    """Rotations, bits, tables and radius for up to ``most`` vectors that are compared with each other.

    From how many bits of the made pairs agree, the bits of a part are chosen for which the fewest rows are
    dealt to blocks. Tables are then added until the made pairs are really found, past ``MOST_TABLES`` for the
    shortest parts. In one dimension there are no such pairs: only equal directions link, and they share every part.
    """
    top = max(LEAST_BITS, min(62, math.ceil(math.log2(max(1, most / BUCKET)))))
    if len(sample) >= LEAST_SAMPLE:
        # Pairs are made from vectors that nothing is learnt from: those fit the rotations better than others do.
        sample = np.random.default_rng(SEED).permutation(sample)
        apart = min(PROBES, len(sample) // 4)
        tried, sample = sample[:apart], sample[apart:]
        mean, rounds = sample.mean(axis=0), ROUNDS
    else:
        tried = sample = _unit(np.random.default_rng(SEED).normal(size=(PROBES, dimensions)))
        mean, rounds = np.zeros(dimensions), 0
    pairs = probes(tried, least)
    rotations: list[np.ndarray] = []
    codes = [np.zeros((len(a), 0), bool) for a, _ in pairs]  # whether the bits of a pair agree

    def need(bits: int) -> None:
        while len(rotations) * dimensions < bits:
            # Starts that are learnt from may end alike in few dimensions; late ones are left as they are drawn.
            late = len(rotations) * dimensions >= LEAST_BITS * MOST_TABLES + 2 * dimensions
            rotations.append(learn_rotation(sample - mean, SEED + len(rotations), 0 if late else rounds))
            for i, (a, b) in enumerate(pairs):
                agree = _code(a - mean, rotations[-1:]) == _code(b - mean, rotations[-1:])
                codes[i] = np.concatenate([codes[i], agree], axis=1)

    def made(bits: int, tables: int) -> Tables:
        length = max(bits * tables, dimensions)
        need(length)
        apart = max((int((~c[:, :length]).sum(axis=1).max()) for c in codes), default=0)
        return Tables(mean, rotations[: -(-length // dimensions)], bits, tables, min(length, math.ceil(SLACK * apart)))

    if not pairs:
        return made(LEAST_BITS, 1)
    need(2 * dimensions)
    agreeing = [c.mean(axis=1) for c in codes]

    def expected(bits: int) -> float:
        """Tables for parts of so many bits, if bits agree independently."""
        missed = lambda t: max(((1 - a**bits) ** t).mean() for a in agreeing)
        return next((t for t in range(1, MOST_TABLES + 1) if missed(t) <= 1 - RECALL), math.inf)

    dealt = {bits: expected(bits) * max(1.0, most / 2**bits / BLOCK) for bits in range(LEAST_BITS, top + 1)}
    for bits in range(min(dealt, key=lambda b: (dealt[b], -b)), LEAST_BITS - 1, -1):
        missed = [np.ones(len(c), bool) for c in codes]
        for tables in range(1, MOST_TABLES + 1) if bits > LEAST_BITS else itertools.count(1):
            need(bits * tables)
            for m, c in zip(missed, codes, strict=True):
                m &= ~c[:, bits * (tables - 1) : bits * tables].all(axis=1)
            if max(m.mean() for m in missed) <= 1 - RECALL:
                return made(bits, tables)
    raise AssertionError("parts of the fewest bits get tables without end")


@dataclass
class Learnt:
    """``Tables`` by number of dimensions. Those that are not ``known`` are made where they are asked for, the same everywhere."""

    known: dict[int, Tables]
    rest: int
    least: float
    made: dict[int, Tables] = field(default_factory=dict)

    def __getitem__(self, dimensions: int) -> Tables:
        if dimensions in self.known:
            return self.known[dimensions]
        if dimensions not in self.made:
            self.made.clear()
            self.made[dimensions] = choose_tables(np.zeros((0, dimensions)), dimensions, self.rest, self.least)
        return self.made[dimensions]


def usable(embedding: Column, label: Column) -> Column:
    """Whether a vector can link: with a label, not null, no component null or not finite, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _tables(classes: DataFrame, least: float) -> Learnt:
    """Tables per number of dimensions, learnt from about ``SAMPLE`` different vectors."""
    groups = classes.groupBy("dimensions", "label").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("dimensions").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    first = sizes.orderBy(F.desc("n"), "dimensions").limit(MOST_LEARNT).collect()
    rest = 0
    if len(first) == MOST_LEARNT:
        rest = sizes.where(~F.col("dimensions").isin([r.dimensions for r in first])).agg(F.max("most")).first()[0] or 0
    share = SAMPLE / max(SAMPLE, sum(r.n for r in first))
    taken = classes.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").collect()
    learnt = {}
    for r in first:
        d = r.dimensions
        rows = [t.embedding for t in taken if len(t.embedding) == d]
        sample = _unit(np.array(rows, np.float64)) if rows else np.zeros((0, d))
        learnt[d] = choose_tables(sample, d, r.most, least)
    return Learnt(learnt, rest, least)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column, in double precision."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


def _coded(classes: DataFrame, learnt: Broadcast) -> DataFrame:
    """``classes`` with ``coded``: the whole code, eight bits a byte, and ``keys``, the part of every table."""
    kind = T.StructType([T.StructField("code", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    @F.arrow_udf(kind)
    def coded(embeddings: pa.Array) -> pa.Array:
        rows = _vectors(embeddings)
        codes: list = [None] * len(rows)
        keys: list = [None] * len(rows)
        for d in {len(r) for r in rows}:
            at = [i for i, r in enumerate(rows) if len(r) == d]
            code = learnt.value[d].code(_unit(np.stack([rows[i] for i in at])))
            packed, parts = np.packbits(code, axis=1), learnt.value[d].parts(code).tolist()
            for i, c, k in zip(at, packed, parts, strict=True):
                codes[i], keys[i] = c.tobytes(), k
        return pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["code", "keys"])

    return classes.withColumn("coded", coded("embedding")).select("*", "coded.*").drop("coded")


def _blocks(coded: DataFrame) -> DataFrame:
    """Rows of block, ``part, node, code``: whose codes are compared, no vectors yet.

    A bucket of more than ``BLOCK`` vectors is dealt into parts by hash, and each pair of parts is a
    block, so a block never holds more than about two parts.
    """
    bucket = ["label", "dimensions", "at", "key"]
    met = coded.select("node", "label", "dimensions", F.posexplode("keys").alias("at", "key"))
    full = stored(met.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "full")
    met = coded.select("node", "label", "dimensions", "code", F.posexplode("keys").alias("at", "key"))
    parts = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK)
    dealt = lookup_join(met, full, bucket, "left", BROADCAST_BYTES).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = paired.select(*bucket, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "code")
    return _by_block(rows)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_BLOCK_COLUMNS).sortWithinPartitions(*_BLOCK_COLUMNS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from batches that are sorted by block."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch[c].to_numpy(zero_copy_only=False) for c in _BLOCK_COLUMNS]
        opens = np.zeros(batch.num_rows, bool)
        opens[0] = True
        for column in names:
            opens[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(opens).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            name = tuple(column[a] for column in names)
            if name != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = name
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _near(rows: pa.Table, tables: Tables) -> np.ndarray:
    """Which pairs of rows (above the diagonal) of a block have codes within the radius and share no earlier part.

    A pair that shares several parts of the code is thus one of the block of the first of them, and only of that.
    """
    n, at = rows.num_rows, rows["at"][0].as_py()
    packed = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(n, -1)
    code = np.unpackbits(packed, axis=1, count=tables.length)
    signs = code.astype(np.float32) * 2 - 1
    near = np.triu(tables.length - signs @ signs.T <= 2 * tables.radius, 1)
    if rows["low"][0].as_py() != rows["high"][0].as_py():
        part = rows["part"].to_numpy()
        near &= part[:, None] != part
    if near.any():
        for key in tables.parts(code).T[:at]:
            near &= key[:, None] != key
    return near


def _candidates(learnt: Broadcast):
    """Per block the rows whose codes have a partner there."""
    columns = [*_BLOCK_COLUMNS, "part", "node"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in _runs(batches):
            if rows.num_rows > 1:
                near = _near(rows, learnt.value[rows["dimensions"][0].as_py()])
                partner = near.any(axis=0) | near.any(axis=1)
                if partner.any():
                    held += rows.select(columns).filter(pa.array(partner)).to_batches()
            if len(held) >= BLOCK:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return candidates


def _compare(learnt: Broadcast, least: float):
    """Per block and vector with a link: its node, the smallest node it is connected with inside, and its links."""

    def block(rows: pa.Table) -> list[np.ndarray]:
        node, size = rows["node"].to_numpy(), rows["size"].to_numpy()
        flat = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = _unit(flat.astype(np.float64).reshape(len(node), -1))
        a, b = np.nonzero(_near(rows, learnt.value[unit.shape[1]]) & (unit @ unit.T >= least))
        links = np.bincount(a, size[b], len(node)) + np.bincount(b, size[a], len(node))
        lowest = node.copy()
        while True:
            before = lowest.copy()
            np.minimum.at(lowest, a, before[b])
            np.minimum.at(lowest, b, before[a])
            if (before == lowest).all():
                break
        linked = np.unique(np.concatenate([a, b]))
        return [node[linked], lowest[linked], links[linked].astype(np.int64)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for rows in _runs(batches):
            held.append(block(rows))
            if len(held) >= BLOCK:
                yield from _linked(held)
                held = []
        yield from _linked(held)

    return compare


def _linked(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["node", "lowest", "links"])


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Per vector ``vec_id, n_links, component_id, kept``, for ``vec_id, embedding, label``.

    Only vectors of one label and one number of dimensions are compared. Equal vectors are one class
    and compared once; they link with each other, and their number counts for all they link with.
    Vectors that cannot link (see ``usable``) are alone. Rows that repeat an id are vectors of their
    own; a null id is never the smallest. Every link that is reported has the cosine; of all
    pairs with it a small part may be missed.
    """
    good = vectors.select("vec_id", "embedding", "label").where(usable(F.col("embedding"), F.col("label")))
    classes = good.groupBy("label", "embedding").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = classes.select("*", F.size("embedding").alias("dimensions"), F.monotonically_increasing_id().alias("node"))
    classes = stored(classes, "classes")
    learnt = vectors.sparkSession.sparkContext.broadcast(_tables(classes, least))
    coded = stored(_coded(classes, learnt), "codes")
    dealt = _blocks(coded)
    near = stored(dealt.mapInArrow(_candidates(learnt), dealt.drop("code").schema), "near")
    met = _by_block(lookup_join(near, coded.select("node", "code", "size", "embedding"), ["node"]))
    found = stored(met.mapInArrow(_compare(learnt, least), "node long, lowest long, links long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select("node", "lowest"))
    members = classes.select("node", "least").join(component, "node")
    lowest = lookup_join(members, members.groupBy("component").agg(F.min("least").alias("component_id")), ["component"])
    judged = classes.join(links, "node", "left").join(lowest.select("node", "component_id"), "node", "left").select(
        "label", "embedding",
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    linked = lookup_join(good, judged, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~usable(F.col("embedding"), F.col("label"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
