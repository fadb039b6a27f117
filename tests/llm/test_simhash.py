"""SimHash balls and connected components against all pairs."""

import random

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tests.llm.fixtures import SMALL, documents, odd_documents, rows
from tracemill.llm import simhash
from tracemill.llm.components import connected_components
from tracemill.llm.queries import op9_simhash_balls


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    """Smallest node that each reaches."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    component = brute_components(ids, links)
    return sorted(((i, f"{prints[i]:016x}", component[i]) for i in ids), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abAB \n\té漢"), max_size=80))
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text), "big") == brute_fingerprint(text)


def test_long_texts_count_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 300)
    text = " ".join(str(i * i % 997) for i in range(2000))
    assert int.from_bytes(simhash.fingerprint(text), "big") == brute_fingerprint(text)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert rows(op9_simhash_balls(spark, SMALL)) == expected(texts)


def test_links_at_two_bits_and_not_at_three(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        chain = [base]
        for _ in range(rng.randint(0, 6)):  # chains: each within 1 to 3 bits of the one before
            value = chain[-1]
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                value ^= 1 << bit
            chain.append(value)
        prints += chain
    prints = sorted(set(prints))
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    nodes = sorted(signed.values())
    links = [(signed[a], signed[b]) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 2]
    frame = spark.createDataFrame([(n,) for n in nodes], "bits long")
    found = dict(connected_components(simhash.links(frame)).collect())
    component = brute_components(nodes, links)
    assert {n: found.get(n, n) for n in nodes} == component
    assert set(found) == {n for link in links for n in link}


def test_runs_may_cross_batches(spark):
    """The links of one run do not depend on where Arrow batches end."""
    frame = spark.createDataFrame([(1 << i,) for i in range(40)] + [(0,)], "bits long")
    whole = rows(simhash.links(frame))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows(simhash.links(frame)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]  # random
    edges += [(500 + i, 501 + i) for i in range(25)]  # a path
    edges += [(rng.randrange(700, 900), 650) for _ in range(150)]  # a star
    edges += [(1000 + rng.randrange(40), 1000 + i) for i in range(40) for _ in range(3)] + [(7, 7), (None, 3), (5, None)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    true = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = {n for e in true for n in e}
    assert found == brute_components(nodes, true)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = rows(simhash.near_duplicates(docs))
    assert len(found) == docs.count()
    zero = "0" * 16
    assert {(2, zero, 2), (3, zero, 2), (4, zero, 2), (None, zero, 2)} <= set(found)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 5, 6]
    assert [r.text for r in kept.where("doc_id IS NULL").collect()] == ["no id at all"]
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.deduplicated(docs.limit(0)).count() == 0


def test_a_third_of_all_rows_may_be_one_text(spark):
    docs = documents(spark, [(i, "one text that everybody copies" if i % 3 else f"text number {i} of its own kind {i * i}") for i in range(300)])
    found = rows(simhash.near_duplicates(docs))
    assert sum(r[2] == 1 for r in found) >= 200


def test_no_text_is_lost_with_a_repeated_id(spark):
    """Two texts of one id, a copy of one under another id, copies without an id, and equal rows."""
    one, two, three = "one text that is of some length", "another one that says other things", "nobody owns this third text at all"
    docs = documents(spark, [(1, one), (1, two), (2, one), *[(None, three)] * 4, (5, two), (1, two), (None, one)])
    kept = simhash.deduplicated(docs).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == sorted([(one, 1), (two, 1), (three, None)], key=lambda r: r[0])


def test_the_kept_row_does_not_depend_on_the_order_of_rows(spark):
    table = [(1, "some text of a document that repeats", lang, "src", n) for lang, n in (("en", 1), ("de", 1), (None, 1), ("en", None), ("en", 2))]
    kept = {tuple(simhash.deduplicated(documents(spark, rows_)).collect()[0]) for rows_ in (table, table[::-1], table[2:] + table[:2])}
    assert len(kept) == 1 and kept <= set(table)
