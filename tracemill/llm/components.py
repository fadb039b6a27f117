"""Connected components of a graph that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.llm.common import stored
from tracemill.operators.joins import lookup_join


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    ``edges`` has two columns of one ordered type; direction, repeats, loops and nulls do not matter
    (a node with nothing but loops or nulls is left out). In each round every node takes its smallest
    neighbour as parent if that is smaller, parents of parents are looked up twice, and the edges are
    rewritten between parents; edges inside a parent vanish. A node that is not smaller than all its
    neighbours merges, so nodes that still have edges at least halve. Minima combine before they are
    shuffled and no list of neighbours is made: a node with a third of the edges is many rows of a
    join, which Spark can split, never one group.
    """
    left, right = edges.columns
    live = _between(edges, F.col(left), F.col(right))
    live = stored(live, "edges")
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            live.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        parent = both.groupBy("node").agg(F.min("other").alias("other")).select(
            "node", F.least("node", "other").alias("component")
        )
        parent = stored(_follow(stored(parent, "parents")), "parents")
        labels = parent if labels is None else stored(_relabel(labels, "component", parent), "labels")
        moved = _relabel(_relabel(live, "a", parent), "b", parent)
        live = stored(_between(moved, F.col("a"), F.col("b")), "edges")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _between(edges: DataFrame, left, right) -> DataFrame:
    """Distinct edges (smaller, larger)."""
    return edges.where(left != right).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()


def _relabel(df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """``column`` replaced by its parent where it has one."""
    parent = parent.select(F.col("node").alias(column), F.col("component").alias("_to"))
    joined = lookup_join(df, parent, [column], "left")
    return joined.withColumn(column, F.coalesce("_to", column)).select(*df.columns)


def _follow(parent: DataFrame) -> DataFrame:
    """Parents replaced by their grandparents, and those by theirs."""
    for _ in range(2):
        parent = _relabel(parent, "component", parent)
    return parent
