"""Ordering results that are expensive to make."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tracemill.session import scratch_folder


def stored_order(df: DataFrame, keys: Sequence[str], label: str = "ordered") -> DataFrame:
    """``df`` by ``keys``, made once: a sort over the whole first looks at its input to find ranges, and then reads it again.

    The rows are written to the scratch folder and sorted from there, so that both looks read the file.
    It runs when it is called.
    """
    folder = scratch_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).orderBy(*keys)
