"""Small tables for the tests of ``tracemill.llm``."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def documents(spark, rows, schema=DOCUMENTS):
    """``rows`` of (doc_id, text) or of all columns, over two partitions."""
    full = [(*r, *([None] * (5 - len(r)))) if isinstance(r, tuple) else r for r in rows]
    return spark.createDataFrame(full, schema).repartition(2)


def odd_documents(spark):
    """Null ids and columns, empty and blank texts, repeated rows, a long text, and other columns with names of results."""
    long = "word " * 30_000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, "no id at all"),
        (1, "the quick brown fox jumps over the lazy dog"), (5, long, "en", "src1", 5), (6, "Ünïcödé 漢字 😀   x"), (None, None),
    ]
    docs = documents(spark, rows)
    names = ("kept", "score", "size", "fingerprint", "component_id", "quality", "language", "_spread", "b1", "key", "place", "row", "copies", "word", "bits")
    return docs.selectExpr("*", *[f"'clash' AS {n}" for n in names])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
