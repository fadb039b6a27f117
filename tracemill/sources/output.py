"""Writers: every result has a folder of its own name."""

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(
    df: DataFrame, folder: str, name: str, mode: str = "overwrite", one_file: bool = False, shuffle: bool = False
) -> str:
    """Write ``df`` with a header to ``folder/name`` and return that path.

    ``one_file`` gives a single part file, written by a single task, whatever the size: ask for it
    where the result is small. With ``shuffle`` the rows are moved to that task, so the stage
    before keeps its parallelism (their order is then not kept).
    """
    path = f"{folder.rstrip('/')}/{name}"
    if one_file:
        df = df.repartition(1) if shuffle else df.coalesce(1)
    df.write.mode(mode).option("header", True).csv(path)
    return path


#: Bytes of a row group where rows are clustered: a lookup reads one, or few.
LOOKUP_ROW_GROUP = 8 << 20


def write_parquet(
    df: DataFrame,
    folder: str,
    name: str,
    mode: str = "overwrite",
    partition_by: str | Sequence[str] | None = None,
    cluster_by: str | None = None,
    row_group: int = LOOKUP_ROW_GROUP,
) -> str:
    """Write ``df`` to ``folder/name``; with ``partition_by``, one sub-folder per value, or per value of each column.

    The rebalance gathers a value's rows in few files and splits a value that is too large. With
    ``cluster_by``, files and row groups (of ``row_group`` bytes) hold ranges of that column, within each sub-folder, and
    have a Bloom filter over it, so that the rows of one value are found without reading the others.
    """
    path = f"{folder.rstrip('/')}/{name}"
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if cluster_by:
        by = [*parts, cluster_by]
        # All columns after the key, so that a value with very many rows is spread over files.
        rest = [c for c in df.columns if c not in by]
        df = df.repartitionByRange(*by, *rest).sortWithinPartitions(*by, *rest)
    elif parts:
        df = df.hint("rebalance", *parts)
    writer = df.write.mode(mode)
    if cluster_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{cluster_by}", "true").option("parquet.block.size", row_group)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return path
