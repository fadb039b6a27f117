"""Alignment of two tokenizers against sets of common ends and all pairs."""

import hashlib
import random
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.fixtures import SMALL, documents, odd_documents
from tracemill.llm import align
from tracemill.llm.queries import op11_run_alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out, linked = [], []
    for text in texts:
        text = text or ""
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        bytes_a = [one.decode([i]).encode() for i in a]
        if "�".encode() in b"".join(bytes_a):  # a token is a part of a character
            alphabet = align.byte_alphabet()
            bytes_a = [bytes(alphabet[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        links, groups = Counter(), []
        if text and b"".join(bytes_a) == whole == b"".join(bytes_b):
            ends = []
            for parts in (bytes_a, bytes_b):
                ends.append([sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 3000 else _running(parts))
            low = 0
            for high in sorted(set(ends[0]) & set(ends[1])):
                groups.append([[i for i, e in zip(ids, end, strict=True) if low < e <= high] for ids, end in zip((a, b), ends, strict=True)])
                low = high
                links.update((x, y) for x in groups[-1][0] for y in groups[-1][1])
        else:
            a, b = [], []
        told = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        out.append([len(a), len(b), len(groups), hashlib.sha256(told.encode()).hexdigest() if groups else ""])
        linked.append(links)
    counts = Counter(pair for links in linked for pair in links)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (*o[:3], sum(c.values()), sum(n for p, n in c.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in c.items()), o[3])
        for o, c in zip(out, linked, strict=True)
    ]


def _running(parts):
    total, out = 0, []
    for p in parts:
        total += len(p)
        out.append(total)
    return out


TEXTS = [
    "plain words in a row", "", None, "  two  spaces\tand\ttabs\n\nlines", "<|endoftext|> and <s> </s> <unk> <0x41>", "漢字 😀 Ünïcödé \u0000",
    " leading", "trailing ", "a" * 500, " " * 300, "▁ lower block", "é combining Å", "plain words in a row", "don't we'll 12345 67,890.12",
]


@pytest.mark.parametrize("head", [align.HEAD_PAIRS, 20, 0])
def test_equals_brute_force(spark, monkeypatch, head):
    """Whatever pairs are broadcast, links and their counts are those of all pairs."""
    monkeypatch.setattr(align, "HEAD_PAIRS", head)
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(documents(spark, list(enumerate(TEXTS)))).collect()}
    assert [found[i] for i in range(len(TEXTS))] == brute(TEXTS)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(texts)
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op11_run_alignment(spark, SMALL).collect()}
    assert [found[i] for i in ids] == brute([texts[i] for i in ids])


def test_common_ends():
    rng = random.Random(3)
    for size in (1, 4, 30, 400):
        for density in (0.05, 0.5, 0.95, 1.0):
            ends = sorted(rng.sample(range(1, 10 * size + 1), 2 * size))
            a = [e for e in ends[:-1] if rng.random() < density] + ends[-1:]
            b = [e for e in ends[:-1] if rng.random() < density] + ends[-1:]
            both = sorted(set(a) & set(b))
            left, right = align.common_ends(np.array(a), np.array(b))
            assert (left.tolist(), right.tolist()) == ([a.index(e) + 1 for e in both], [b.index(e) + 1 for e in both])


def test_links_of_large_groups():
    first, second = [1, 2, 1] * 50, [7, 8] * 40
    large = align.Aligned(*map(np.array, (first + [3], second + [9], [150, 151], [80, 81], [1, 2])))
    text, pairs, times = large.links()
    assert text.tolist() == [0] * 4 + [1] and pairs[-1] == 3 << 32 | 9
    pairs, times = pairs[:-1], times[:-1]
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == Counter(a << 32 | b for a in first for b in second)
    assert align._unpacked(pairs.tobytes(), align._packed(times))[1].tolist() == times.tolist()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = align.align(docs).collect()
    assert len(found) == docs.count()
    empty = [r for r in found if r.doc_id in (2, 3)]
    assert len(empty) == 2 and all(tuple(r[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "") for r in empty)
    assert align.align(docs.limit(0)).count() == 0


def test_words_apart_equal_whole_texts(spark):
    """The kept words give what both libraries give for whole texts."""
    aligner = align.Aligner(*align._shared(spark, None, None).value)
    assert aligner.apart
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect() if r.text]
    texts += [t for t in TEXTS if t] + ["one\ntwo three\nfour", "a\nb", "x\u0301 \u0301y\n\u0301z", "<|endoftext|> a\n<|endoftext|>", "w" * 70 + " short"]
    assert aligner.ranked is not None
    ones = [array("I", aligner.first.encode(" " + t, add_special_tokens=False).ids).tobytes() for t in texts]
    twos = [array("I", aligner.second.encode(t)).tobytes() for t in texts]
    found = aligner.encode(texts)
    assert len(aligner.kept) > 1000 and sum(bool(x) for x, _ in found) > len(texts) - 10
    assert all(f in ((one, two), (b"", b"")) for f, one, two in zip(found, ones, twos, strict=True))
    aligner.apart, aligner.ranked = False, None
    assert aligner.encode(texts) == found
