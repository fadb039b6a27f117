"""Histograms as grouped counts."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tracemill.functions.columns import bucket_of, centred_bin


def bucket_histogram(
    df: DataFrame, measures: Mapping[str, str], edges: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Rows per bucket for each measure (output name -> input column), empty buckets as 0.

    With ``weight``, that column is added up instead of counting rows. Rows are counted by the
    buckets of all measures together, and only those counts, a few hundred, are told apart by measure; see
    :func:`bucket_of` for the bucket limits.
    """
    bucketed = df.select(
        *[bucket_of(F.col(source), edges).alias(name) for name, source in measures.items()],
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_weight"),
    )
    cells = bucketed.groupBy(*measures).agg(F.sum("_weight").alias("_weight"))
    counts = (
        cells.unpivot(["_weight"], list(measures), "_measure", "bucket")
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(*[F.sum(F.when(F.col("_measure") == name, F.col("_weight"))).alias(name) for name in measures])
    )
    middles = F.array(*[F.lit((low + high) / 2) for low, high in zip(edges, edges[1:])])
    buckets = df.sparkSession.range(len(edges) - 1, numPartitions=1).withColumnRenamed("id", "bucket")
    return (
        buckets.join(counts, "bucket", "left")
        .select("bucket", F.get(middles, F.col("bucket").cast("int")).alias("midpoint"),
                *[F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name) for name in measures])
        .orderBy("bucket")
    )


def centred_histogram(df: DataFrame, column: str, width: int, name: str) -> DataFrame:
    """Rows per bin of ``width`` centred on its multiples; nulls are left out, empty bins not listed."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(centred_bin(F.col(column), width).alias("bin"))
        .agg(F.count("*").alias(name))
        .orderBy("bin")
    )
