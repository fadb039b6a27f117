"""Conversations as a trie of their turns, in balanced parentheses.

Every conversation is cut into segments of up to ``BAND`` turns; equal segments after the same turns are
one row with a count. Sorted, they are the trie's nodes in order, and a shard is a run of them: an opening
parenthesis where a turn is new, a closing one where it is left. Range minima of the excess over blocks
find the parenthesis that closes a node, which delimits its subtree; the rank there counts leaves (pairs
"()"), and cumulative arrays give members and savings. The nodes on the two edges of a shard, its spines, may go on in the
next one: they leave the shard as partial sums and are merged by their key.

No step gathers a conversation, a group of copies or a subtree in one task: turns are numbered within ranges
of a sort, equal conversations are one row before they meet, and what lies below a segment of a
conversation longer than ``BAND`` is added by doubling over segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.llm.common import stored
from tracemill.operators.joins import lookup_join

#: Turns of a segment.
BAND = 512
#: A shard ends where it has so many segments or turns.
SHARD_SEGMENTS, SHARD_TURNS = 1 << 15, 1 << 20
#: Positions of one block of the excess.
BLOCK = 32
#: Conversations that start alike: the group, and the first turns that may be shared.
GROUP, SHARED = 20, 4
#: Ids that end at one node are joined in pieces of so many consecutive numbers (as a power of two).
ID_BITS = 12
DIGEST_BYTES = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Key of the node without turns.
ROOT = bytes(DIGEST_BYTES)


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, content, words, part``; ``part`` is a range of the order by all of them."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ranged = turns.repartitionByRange("conv_id", "turn", "content")
    return stored(ranged.withColumn("part", F.spark_partition_id()), "turns")


def _plan(turns: DataFrame) -> DataFrame:
    """Per conversation and part of it: the turns ``before`` it, and how the conversation is rebuilt.

    ``skip`` own turns go, ``kept`` turns of ``base`` take their place, and ``length`` turns it has then.
    """
    sizes = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select(
        "conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"),
        shared_turns(F.col("conv_id")).alias("skip"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
    )
    parts = stored(parts, "parts")
    first = parts.where("before = 0 and conv_id = base").select("base", F.col("total").alias("has"))
    kept = F.least("skip", F.coalesce("has", F.lit(0)))
    planned = parts.join(first, "base", "left").withColumn("kept", kept)
    return stored(planned.withColumn("length", F.col("kept") + F.greatest(F.col("total") - F.col("skip"), F.lit(0))).drop("has", "total"), "plan")


def _numbered(turns: DataFrame, plan: DataFrame) -> DataFrame:
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "content")
    return turns.join(plan, ["conv_id", "part"]).withColumn("at", F.row_number().over(within) - 1 + F.col("before"))


def _rebuilt(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, at, content, words, length`` of all turns of the rebuilt conversations."""
    own = _numbered(turns, plan).where("at >= skip").withColumn("at", F.col("at") - F.col("skip") + F.col("kept"))
    bases = _numbered(turns.where(F.col("conv_id") % GROUP == 0), plan).where(F.col("at") < SHARED - 1)
    heads = plan.where("before = 0 and kept > 0").select("conv_id", "base", "kept", "length").join(
        bases.select("base", "at", "content", "words"), "base"
    ).where("at < kept")
    columns = ["conv_id", "at", "content", "words", "length"]
    return own.select(columns).union(heads.select(columns))


def _segments(rebuilt: DataFrame, band: int) -> DataFrame:
    """``conv_id, band, root, path, words, ended, below``: what of a conversation lies in one band.

    ``root`` is a key of all turns before, ``path`` the digests of its own turns, ``below`` the key of the
    next segment's root, null for the last.
    """
    number = F.floor(F.col("at") / band).cast("long")
    turn = F.struct("at", "content", "words")
    gathered = rebuilt.groupBy("conv_id", number.alias("band"), "length").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segments = gathered.select(
        "conv_id", "band", F.unhex(F.array_join(F.col("turns.content"), "")).alias("path"), F.col("turns.words").alias("words"),
        (F.col("length") <= (F.col("band") + 1) * band).alias("ended"),
    )
    # Two independent 64-bit hashes of each segment and its number; those before are combined in any order.
    one, two = F.xxhash64(F.lit(1), "band", "path"), F.xxhash64(F.lit(2), "path", "band")
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    hashed = segments.withColumns({"one": one, "two": two}).withColumns({
        "r1": F.coalesce(F.bit_xor("one").over(before), F.lit(0)), "r2": F.coalesce(F.bit_xor("two").over(before), F.lit(0)),
    })

    def key(band: Column, r1: Column, r2: Column) -> Column:
        return F.when(band == 0, F.lit(ROOT)).otherwise(F.unhex(F.md5(F.concat_ws(",", band, r1, r2).cast("binary"))))

    following = key(F.col("band") + 1, F.col("r1").bitwiseXOR(F.col("one")), F.col("r2").bitwiseXOR(F.col("two")))
    return hashed.select(
        "conv_id", "band", key(F.col("band"), F.col("r1"), F.col("r2")).alias("root"), "path", "words", "ended",
        F.when(~F.col("ended"), following).alias("below"),
    )


def _place(root: str = "root", path: str = "path") -> Column:
    return F.md5(F.concat(root, path))


def _end_digests(ends: DataFrame) -> DataFrame:
    """``place, ends``: SHA-256 of the ids in ``conv_id`` at each place, ascending, with commas.

    Ids are joined in pieces before they meet, so the task of a place that very many share reads few rows,
    one after the other, and holds one of them.
    """
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    joined = ends.groupBy("place", F.shiftright("conv_id", ID_BITS).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    return joined.repartition("place").sortWithinPartitions("place", "piece").mapInArrow(_sha, "place string, ends string")


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sha = None, None
    for batch in batches:
        done = []
        for at, ids in zip(batch["place"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if at != place:
                if place is not None:
                    done.append((place, sha.hexdigest()))
                place, sha = at, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _rows(done)
    if place is not None:
        yield _rows([(place, sha.hexdigest())])


def _rows(done: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = [pa.array([d[k] for d in done], pa.string()) for k in range(2)]
    return pa.RecordBatch.from_arrays(columns, ["place", "ends"])


class Parentheses:
    """A forest as balanced parentheses: ``opened[i]`` nodes are opened after ``closed[i]`` were closed."""

    def __init__(self, closed: np.ndarray, opened: np.ndarray):
        turns = np.empty(2 * len(opened), np.int64)
        turns[0::2], turns[1::2] = closed, opened
        signs = np.repeat(np.tile(np.array([-1, 1], np.int8), len(opened)), turns)
        self.signs = np.append(signs, np.full(int(signs.sum(dtype=np.int64)), -1, np.int8))
        self.excess = np.cumsum(self.signs, dtype=np.int32)
        self.opens = np.flatnonzero(self.signs == 1)
        self.rank = np.cumsum(self.signs == 1)  # nodes opened up to a position
        blocks = -(-len(self.excess) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(self.excess)] = self.excess
        self.blocks = padded.reshape(blocks, BLOCK)
        self.minima = [self.blocks.min(axis=1)]
        while len(self.minima[-1]) > 1:
            level = self.minima[-1]
            level = np.append(level, np.iinfo(np.int32).max) if len(level) % 2 else level
            self.minima[-1] = level
            self.minima.append(level.reshape(-1, 2).min(axis=1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes the one at each position: the next of less excess."""
        target = self.excess[at] - 1
        block, offset = np.divmod(at, BLOCK)
        out = np.full(len(at), -1, np.int64)
        later = np.arange(BLOCK)
        for start in range(0, len(at), 1 << 14):
            part = slice(start, start + (1 << 14))
            fits = (self.blocks[block[part]] <= target[part, None]) & (later > offset[part, None])
            hit = fits.argmax(axis=1)
            found = fits[np.arange(len(hit)), hit]
            out[part] = np.where(found, block[part] * BLOCK + hit, -1)
        open_ = np.flatnonzero(out < 0)
        node, level = block[open_], np.zeros(len(open_), np.int64)
        climbing = np.ones(len(open_), bool)
        for k, minima in enumerate(self.minima[:-1]):  # up, until a right neighbour goes as low as the target
            sibling = np.minimum(node + 1, len(minima) - 1)
            turns = climbing & (node % 2 == 0) & (minima[sibling] <= target[open_])
            level[turns] = k
            node = np.where(turns, sibling, np.where(climbing, node // 2, node))
            climbing &= ~turns
        for k in range(len(self.minima) - 1, 0, -1):  # and down, to the first block that does
            down = np.flatnonzero(level >= k)
            left = 2 * node[down]
            node[down] = left + (self.minima[k - 1][left] > target[open_[down]])
        for start in range(0, len(open_), 1 << 14):
            part = slice(start, start + (1 << 14))
            fits = self.blocks[node[part]] <= target[open_[part], None]
            out[open_[part]] = node[part] * BLOCK + fits.argmax(axis=1)
        return out

    def leaves(self) -> np.ndarray:
        """Whether each node is a pair "()"."""
        return self.signs[self.opens + 1] == -1


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value from ``first`` to ``last``, by two overlapping powers of two."""
    level, out = values, np.empty(len(first), values.dtype)
    reach = np.frexp((last - first + 1).astype(np.float64))[1] - 1  # the largest power within the range
    for k in range(int(reach.max(initial=0)) + 1):
        mine = np.flatnonzero(reach == k)
        out[mine] = np.minimum(level[first[mine]], level[last[mine] - (1 << k) + 1])
        if len(level) > 1 << k:
            level = np.minimum(level[: -(1 << k)], level[1 << k :])
    return out


_NODE = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), ("spine", pa.list_(pa.binary())), ("top", pa.bool_()), ("depth", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string()), ("below", pa.binary()), ("more_leaves", pa.int64()), ("more_saved", pa.int64()),
])
_NODE_SQL = (
    "key binary, parent binary, spine array<binary>, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, words long, ends string, below binary, more_leaves long, more_saved long"
)


def _common(a: bytes, b: bytes) -> int:
    """Leading digests that two paths share."""
    low, high = 0, min(len(a), len(b)) // DIGEST_BYTES
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGEST_BYTES] == b[: middle * DIGEST_BYTES]:
            low = middle
        else:
            high = middle - 1
    return low


def shard_nodes(rows: list[tuple], band: int) -> pa.RecordBatch:
    """All nodes of a shard: ``rows`` are (root, band, path, words, n, least, ends, below, more_leaves, more_saved), sorted.

    A node on a spine has a ``key`` and counts only what hangs off the spines; others are final. A node
    whose parent is on a spine or before the band names it as ``parent``.
    """
    root, number, path, words, n, least, ends, below, more_leaves, more_saved = zip(*rows, strict=True)
    length = np.array([len(p) // DIGEST_BYTES for p in path])
    common = np.array([0] + [_common(path[i - 1], path[i]) if root[i - 1] == root[i] else 0 for i in range(1, len(path))])
    opened, closed = length - common, np.append(0, length[:-1] - common[1:])
    trie = Parentheses(closed, opened)
    segment = np.repeat(np.arange(len(path)), opened)
    depth = trie.excess[trie.opens]
    end = trie.rank[trie.findclose(trie.opens)]  # one past the last node of the subtree
    last = segment[end - 1]
    n_convs = np.append(0, np.cumsum(n))
    n_convs = n_convs[last + 1] - n_convs[segment]
    conv_id = _range_minima(np.array(least, np.int64), segment, last)
    spine = (segment == 0) | (last == len(path) - 1)
    own_words = np.concatenate([np.array(w[c:], np.int64) for w, c in zip(words, common.tolist(), strict=True)])
    bottom = depth == length[segment]  # the node a segment ends at; it is the one the segment opened last
    goes_on = bottom & np.array([b is not None for b in below])[segment]
    more_l, more_s = (np.where(goes_on, np.array(m, np.int64)[segment], 0) for m in (more_leaves, more_saved))
    leaf = np.where(spine, 0, (trie.leaves() & ~goes_on) + more_l)
    saved = np.where(spine, 0, (n_convs - 1) * own_words + more_s)
    leaf_sums, saved_sums = (np.append(0, np.cumsum(v)) for v in (leaf, saved))
    at = np.arange(len(depth))

    parent, open_nodes, start = at - 1, [-1] * (band + 1), 0
    for c, o in zip(common.tolist(), opened.tolist(), strict=True):
        parent[start] = open_nodes[c]
        open_nodes[c + 1 : c + o + 1] = range(start, start + o)
        start += o
    top = parent < 0
    inner = ~top & ~spine[parent]
    children = np.bincount(parent[inner], minlength=len(at))

    keys: dict[int, bytes] = {}
    chains: dict[int, list[bytes]] = {}
    for i in np.flatnonzero(spine).tolist():
        s = int(segment[i])
        keys[i] = hashlib.blake2b(root[s] + path[s][: int(depth[i]) * DIGEST_BYTES], digest_size=DIGEST_BYTES).digest()
        chains[i] = [*chains.get(int(parent[i]), []), keys[i]]
    named = [root[s] if p < 0 else keys.get(p) for p, s in zip(parent.tolist(), segment.tolist(), strict=True)]
    bottoms = np.flatnonzero(bottom)
    end_of = dict(zip(bottoms.tolist(), segment[bottoms].tolist(), strict=True))
    columns = [
        [keys.get(i) for i in range(len(at))], named, [chains.get(i) for i in range(len(at))], top,
        depth + np.array(number, np.int64)[segment] * band, conv_id, pa.array(conv_id[parent], pa.int64(), mask=~inner),
        n_convs, children, leaf_sums[end] - leaf_sums[at], saved_sums[end] - saved_sums[at], own_words,
        [ends[end_of[i]] if i in end_of else None for i in range(len(at))],
        [below[end_of[i]] if i in end_of else None for i in range(len(at))], more_l, more_s,
    ]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_NODE)


_SEGMENT = ["root", "band", "path", "words", "n", "least", "ends", "below", "more_leaves", "more_saved"]


def _shards(batches: Iterator[pa.RecordBatch], band: int, most: int) -> Iterator[pa.RecordBatch]:
    held, turns = [], 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in _SEGMENT), strict=True):
            held.append(row)
            turns += len(row[3])
            if len(held) >= most or turns >= SHARD_TURNS:
                yield shard_nodes(held, band)
                held, turns = [], 0
    if held:
        yield shard_nodes(held, band)


def _nodes(segments: DataFrame, band: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that are final, and those of the merged spines; both with ``kids``, the children that name them."""
    ordered = segments.select(_SEGMENT).repartitionByRange("root", "path").sortWithinPartitions("root", "path")
    nodes = stored(ordered.mapInArrow(partial(_shards, band=band, most=SHARD_SEGMENTS), _NODE_SQL), "nodes")
    final = nodes.where("key IS NULL")
    same = [F.first(c, ignorenulls=True).alias(c) for c in ("parent", "spine", "top", "depth", "words", "ends", "below")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")]
    more = [F.max(c).alias(c) for c in ("more_leaves", "more_saved")]
    spines = stored(nodes.where("key IS NOT NULL").groupBy("key").agg(*same, F.min("conv_id").alias("conv_id"), *sums, *more), "spines")
    named = final.select("parent").union(spines.select("parent")).where("parent IS NOT NULL")
    kids = stored(named.groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("kids")), "kids")
    spines = spines.join(kids, F.coalesce("below", "key") == F.col("at"), "left").withColumn("n_children", F.coalesce("kids", F.lit(0))).drop("at", "kids")
    own = spines.select(
        F.explode("spine").alias("key"),
        (F.when(F.col("below").isNull() & (F.col("n_children") == 0), 1).otherwise(0) + F.col("more_leaves")).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words") + F.col("more_saved")).alias("saved"),
    )
    added = own.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    spines = spines.join(added, "key").withColumns({
        "n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("saved"),
    })
    through = final.where("below IS NOT NULL").join(kids, F.col("below") == F.col("at")).withColumn("n_children", F.col("kids"))
    columns = ["parent", "top", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "below"]
    final = final.where("below IS NULL").select(columns).union(through.select(columns))
    spines = stored(spines.withColumn("parent_conv_id", F.lit(None).cast("long")).select("key", *columns), "spines")
    return final, spines


def _tops(final: DataFrame, spines: DataFrame) -> DataFrame:
    """``root, n_leaves, saved_tokens``: sums over the first nodes after each root."""
    both = final.where("top").select("parent", "n_leaves", "saved_tokens").union(spines.where("top").select("parent", "n_leaves", "saved_tokens"))
    return both.groupBy(F.col("parent").alias("root")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _with_below(segments: DataFrame, band: int, bands: int) -> DataFrame:
    """``segments`` with all leaves and savings below the root of the next band, where there is one.

    A root's sums reach twice as many bands down in each round, by way of the root twice as far up.
    """
    if bands < 2:
        return segments
    up = segments.where("below IS NOT NULL").select(F.col("below").alias("root"), F.col("root").alias("up"))
    sums = stored(_tops(*_nodes(segments, band)).join(up, "root", "left"), "sums")
    reach = 1
    while reach < bands:
        lower = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("root")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        higher = sums.select(F.col("root").alias("up"), F.col("up").alias("next"))
        joined = lookup_join(sums, higher, ["up"], "left").join(lower, "root", "left")
        sums = stored(joined.select(
            "root", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"), F.col("next").alias("up"),
        ), "sums")
        reach *= 2
    known = sums.select(F.col("root").alias("below"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
    return segments.drop("more_leaves", "more_saved").join(known, "below", "left").fillna(0, ["more_leaves", "more_saved"])


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations, one row each: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    Null turns come first; rows of one turn come in the order of an MD5 of role and text, repeated rows are turns each. Null role
    and text are empty. Rows without ``conv_id`` belong to no conversation and are left out; ``conv_id % 20`` has the
    sign of ``conv_id``. Without a conversation there is no node, not even the root. Other columns are not read.
    """
    turns = _turns(conversations)
    plan = _plan(turns)
    single = stored(_segments(_rebuilt(turns, plan), band), "segments")
    without = plan.where("before = 0 and length = 0").select(F.lit("").alias("place"), "conv_id")
    ends = stored(_end_digests(single.where("ended").select(_place().alias("place"), "conv_id").union(without)), "ends")
    bands = (single.agg(F.max("band")).first()[0] or 0) + 1
    segments = single.groupBy("root", "band", "path").agg(
        F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("below").alias("below"),
    ).withColumn("place", _place()).join(ends, "place", "left").drop("place")
    segments = stored(segments.withColumns({"more_leaves": F.lit(0).cast("long"), "more_saved": F.lit(0).cast("long")}), "segments")
    final, spines = _nodes(_with_below(segments, band, bands), band)

    everyone = plan.where("before = 0").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    first = final.where("top").select("parent", "n_leaves", "saved_tokens").union(spines.where("top").select("parent", "n_leaves", "saved_tokens"))
    totals = first.where(F.col("parent") == F.lit(ROOT)).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    # Both have one row.
    top = everyone.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one").join(
        ends.where("place = ''").select(F.lit(1).alias("one"), "ends"), "one", "left"
    )
    top = stored(top.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "ends",
    ), "root")
    parents = spines.where("below IS NULL").select(F.col("key").alias("parent"), F.col("conv_id").alias("_of"))
    for through in (final, spines):
        parents = parents.union(through.where("below IS NOT NULL").select("below", "conv_id"))
    parents = parents.union(top.select(F.lit(ROOT), "conv_id"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    columns = ["parent", *result]
    naming = final.where("parent IS NOT NULL").select(columns).union(spines.select(columns))
    named = lookup_join(naming, parents, ["parent"]).withColumn("parent_conv_id", F.col("_of"))
    rows = final.where("parent IS NULL").select(result).union(named.select(result)).union(top.select(result))
    return rows.withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY_SHA))).drop("ends")
