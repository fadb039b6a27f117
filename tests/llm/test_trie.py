"""The trie of conversations against DuckDB and a trie of tuples; its parentheses against a stack."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tests.compare import duckdb_over, duckdb_rows, spark_rows
from tests.llm.fixtures import FOLDER, SMALL, rows
from tracemill.llm import trie
from tracemill.llm.queries import ORACLE_SQL, op13_parentheses_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(table):
    turns = {}
    for c, t, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((t is not None, t or 0, digest), (role, text)))
    turns = {c: [v for _, v in sorted(found)] for c, found in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members, children = {}, {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode().split()) if node else 0
        saved[node] = own + sum(saved[b] for b in below)
        ends = ",".join(str(c) for c in sorted(members[node]) if whole[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed, conversations=90, lengths=(0, 1, 2, 3, 5, 12)):
    rng = random.Random(seed)
    return [
        (c, rng.choice([t, t, t, None]), rng.choice(["user", "user", "assistant", None]), rng.choice(["x y", "x y", "z z", None, "w\tw  w"]))
        for c in rng.sample(range(-40, 300), conversations) for t in range(rng.choice(lengths))
    ]


@pytest.mark.parametrize("folder", [SMALL, FOLDER])
def test_equals_duckdb(spark, folder):
    assert spark_rows(op13_parentheses_trie(spark, folder)) == duckdb_rows(duckdb_over(folder), ORACLE_SQL["op13_parentheses_trie"])


@pytest.mark.parametrize(("band", "segments", "seed"), [(512, 1 << 15, 1), (2, 3, 2), (1, 1, 3), (3, 5, 4)])
def test_equals_brute_force(spark, monkeypatch, band, segments, seed):
    """Whatever the length of a segment and the size of a shard, spines and bands merge to the same nodes."""
    monkeypatch.setattr(trie, "SHARD_SEGMENTS", segments)
    conversations = table(seed)
    found = trie.prefix_trie(spark.createDataFrame(conversations, SCHEMA).repartition(5), band)
    assert rows(found.select(COLUMNS)) == brute(conversations)


def test_copies_and_a_long_conversation(spark, monkeypatch):
    """Most conversations are one, and one holds most of the turns; pieces of ids and bands are many."""
    monkeypatch.setattr(trie, "ID_BITS", 3)
    copies = [(c, t, "user", f"same {t}") for c in range(400) for t in range(6)]
    long = [(1000, t, "user", f"turn {t // 2}") for t in range(3000)] + [(1003, t, "user", f"turn {t // 2}") for t in range(2500)]
    found = trie.prefix_trie(spark.createDataFrame(copies + long, SCHEMA).repartition(7), 64)
    assert rows(found.select(COLUMNS)) == brute(copies + long)


def test_odd_rows(spark):
    odd = [
        (None, 0, "user", "nobody's"), (1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (5, 0, "", "long " * 20_000),
        (20, 1, "a", "b"), (20, 1, "ab", ""), (21, 0, "a", "b"), (-19, 0, "x", "y"), (-20, 0, "x", "y"), (-20, 0, "x", "y"),
    ]
    names = ("part", "at", "path", "words", "key", "parent", "depth", "n_convs", "ends", "place", "band", "root", "base", "_of")
    extra = spark.createDataFrame(odd, SCHEMA).selectExpr("*", *[f"'clash' AS {n}" for n in names])
    assert rows(trie.prefix_trie(extra).select(COLUMNS)) == brute(odd)
    assert trie.prefix_trie(extra.limit(0)).count() == 0
    assert trie.prefix_trie(extra.where("conv_id IS NULL")).count() == 0


def test_conversations_without_turns_are_in_the_root(spark):
    lone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1][:3]
    found = trie.prefix_trie(spark.createDataFrame([(c, 0, "user", "goes") for c in lone], SCHEMA)).collect()
    ends = hashlib.sha256(",".join(map(str, lone)).encode()).hexdigest()
    assert [tuple(r[c] for c in COLUMNS) for r in found] == [(lone[0], 0, None, 3, 0, 1, 0, ends)]


def test_findclose_and_leaves():
    rng = np.random.default_rng(7)
    for size in (1, 5, 40, 3000):
        opened = rng.integers(1, 6, size)
        closed, depth = np.zeros(size, np.int64), 0
        for i in range(size):
            closed[i] = rng.integers(0, depth + 1)
            depth += opened[i] - closed[i]
        forest = trie.Parentheses(closed, opened)
        stack, close = [], {}
        for at, sign in enumerate(forest.signs.tolist()):
            if sign > 0:
                stack.append(at)
            else:
                close[stack.pop()] = at
        assert not stack and forest.findclose(forest.opens).tolist() == [close[p] for p in forest.opens.tolist()]
        assert forest.leaves().tolist() == [close[p] == p + 1 for p in forest.opens.tolist()]
