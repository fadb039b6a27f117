"""Mixing sources to target weights by nested hash thresholds.

A document's place in its source is a hash of its id and text. A source with target T and size S is taken
``floor(T / S)`` times whole, and once more below a threshold of the hash that is chosen so that
the documents below it hold the rest. The threshold comes from histograms of tokens over the leading
bits; only the bucket it falls into is looked at more closely, twice. So nothing is sorted, thresholds
of smaller budgets are nested in those of larger ones, and a rerun takes the same documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tracemill.llm.common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Bits of the hash per histogram, and histograms.
LEVEL_BITS, LEVELS = 12, 3


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return pa.array([len((t.as_py() or "").encode().split()) for t in texts], pa.int64())


def place(doc_id: Column, text: Column) -> Column:
    """The leading 36 bits of the MD5 of the id as text ('n' for null), a colon and the text ('' for null)."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("n")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """A text that is never null and different for every source, null included."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _level(place: str, level: int) -> Column:
    return F.shiftright(place, LEVEL_BITS * (LEVELS - level)).bitwiseAND((1 << LEVEL_BITS) - 1)


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums over all rows before each in ``order``, which no two rows share; no task holds them all.

    Ranges of the order add up their own rows, and the totals of the ranges, one row each, are added up in turn.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = before(Window.orderBy("_part"))
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    within = before(Window.partitionBy("_part").orderBy(*order))
    joined = ranged.join(offsets, "_part")
    return joined.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()}).drop("_part", *[f"_{n}" for n in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """``key, source_size, target`` from ``key, source, source_size``, one row per source.

    With targets in order of target per weight, a source is full if sharing what is left among it
    and those after it would give it more than its limit; the first that is not full sets the
    share per weight. Sums are of whole numbers, so they are the same in any order.
    """
    numbered = _running(sizes, [F.col("source").isNull(), F.col("source")], {"number": F.lit(1)})
    weighed = numbered.select(
        "key", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("number") % len(WEIGHTS) + 1).cast("int")).alias("weight"),
        (F.lit(float(REPEATS)) * F.col("source_size")).alias("most"),
    ).withColumn("turn", F.col("most") / F.col("weight"))
    ordered = stored(_running(weighed, [F.col("turn"), F.col("key")], {"full": F.col("most"), "weights": F.col("weight")}), "targets")
    size, weight = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    share = (F.lit(SHARE * (size or 0)) - F.col("full")) / (F.lit(weight or 0.0) - F.col("weights"))
    open_ = F.when(share * F.col("weight") <= F.col("most"), F.struct("turn", share.alias("share")))
    least = ordered.agg(F.min(open_).alias("least")).first().least
    target = F.least("most", F.lit(least.share) * F.col("weight")) if least else F.col("most")
    return ordered.select("key", "source_size", target.alias("target"))


def _boundary(cells: DataFrame, bucket: str) -> DataFrame:
    """``cells`` (key, bucket, tokens, rest) with ``before`` and ``upto``, the running tokens in the key."""
    running = Window.partitionBy("key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("tokens").over(running)
    return cells.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("tokens"))


def thresholds(sized: DataFrame) -> DataFrame:
    """Per occupied ``(key, b1)`` cell of ``sized`` (key, source, size, place): the whole turns and the last place taken.

    Windows run over the cells of one source, at most 4,096 at each level.
    """
    cells = stored(
        sized.groupBy("key", _level("place", 1).alias("b1")).agg(F.first("source").alias("source"), F.sum("size").alias("tokens")),
        "histogram",
    )
    sources = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("tokens").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets(sources).withColumn("turns", whole).withColumn("rest", F.col("target") - F.col("turns") * F.col("source_size"))
    first = _boundary(cells.drop("source").join(plan, "key"), "b1")
    first = stored(first, "cells")
    crossing = lambda cells, bucket: (  # noqa: E731  the first cell that holds more than what is left, per key
        cells.where(F.col("upto") > F.col("rest"))
        .groupBy("key").agg(F.min(F.struct(bucket, (F.col("rest") - F.col("before")).alias("rest"))).alias("c"))
        .select("key", F.col(f"c.{bucket}").alias(bucket), "c.rest")
    )
    edge = crossing(first, "b1")
    inside = sized.withColumn("b1", _level("place", 1)).join(edge, ["key", "b1"])
    second = inside.groupBy("key", "b1", _level("place", 2).alias("b2")).agg(F.first("rest").alias("rest"), F.sum("size").alias("tokens"))
    edge = edge.drop("rest").join(crossing(_boundary(second, "b2"), "b2"), "key")
    inside = sized.withColumns({"b1": _level("place", 1), "b2": _level("place", 2)}).join(edge, ["key", "b1", "b2"])
    third = inside.groupBy("key", "b1", "b2", _level("place", 3).alias("b3")).agg(F.first("rest").alias("rest"), F.sum("size").alias("tokens"))
    third = _boundary(third, "b3").where(F.col("upto") > F.col("rest"))
    nearer = F.col("upto") + F.col("before") < 2 * F.col("rest")
    unit = 1 << LEVEL_BITS
    last = (F.col("c.b1") * unit + F.col("c.b2")) * unit + F.col("c.b3") - F.when(F.col("c.nearer"), 0).otherwise(1)
    edge = third.groupBy("key").agg(F.min(F.struct("b3", "b1", "b2", nearer.alias("nearer"))).alias("c")).select("key", last.alias("last"))
    return first.join(edge, "key", "left").select("key", "b1", "source_size", "target", "turns", F.coalesce("last", F.lit(-1)).alias("last"))


def _copies(placed: DataFrame, rules: DataFrame) -> DataFrame:
    """``placed`` (key, place) with its source's rule and ``copies``; a hot source is spread over its cells."""
    placed = placed.withColumn("b1", _level("place", 1))
    more = F.when(F.col("place") <= F.col("last"), 1).otherwise(0)
    # Where all are taken as often as may be, documents without words below the first threshold are, too.
    return placed.join(rules, ["key", "b1"]).withColumn("copies", F.least(F.col("turns") + more, F.lit(REPEATS)))


def _sized(docs: DataFrame) -> DataFrame:
    return stored(
        docs.select("doc_id", _key(F.col("source")).alias("key"), "source", word_count("text").alias("size"), place(F.col("doc_id"), F.col("text")).alias("place")),
        "sizes",
    )


def mix(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``; ``taken`` counts the words of all its copies.

    A null text has size 0, null sources are one source, the last. A source without words has target 0.
    Rows that repeat both id and text are at one place and taken alike; others have places of their own, also without
    an id. Of the two places around a budget, that which comes nearer to it is the threshold, so a source is off
    by at most half of what is there: half a document, or half of its repeated rows together.
    Other columns are not read.
    """
    sized = _sized(docs)
    taken = _copies(sized, thresholds(sized))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them: not at all, once or repeated."""
    rules = thresholds(_sized(docs)).select("key", "b1", "turns", "last")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _key(F.col("source")).alias("key"), place(F.col("doc_id"), F.col("text")).alias("place"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return _copies(held, rules).where("copies > 0").select("row", copies.alias("copy")).select("row.*")
