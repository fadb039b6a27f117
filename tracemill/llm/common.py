"""What several of these operators need: stored intermediate tables, names, pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.session import scratch_folder

#: A Python function works on so much text and so many rows at once: memory does not follow the batch.
PIECE_CHARS = 1 << 20
PIECE_ROWS = 256


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share, and read again.

    This cuts the lineage: a lost executor costs no recomputation of what stands before it.
    """
    folder = scratch_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(texts: pa.Array, chars: int = PIECE_CHARS, rows: int = PIECE_ROWS) -> Iterator[list[str | None]]:
    """The texts of an Arrow array in order, as lists that end where they reach either bound."""
    piece: list[str | None] = []
    held = 0
    for text in texts:
        value = text.as_py()
        piece.append(value)
        held += len(value or "") + 1
        if held >= chars or len(piece) >= rows:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


def per_text(function: Callable[[list[str | None]], list[tuple]], kind: pa.StructType) -> Callable[[pa.Array], pa.Array]:
    """The body of an Arrow function from texts to structs, worked off piece by piece."""

    def apply(texts: pa.Array) -> pa.Array:
        chunks = []
        for piece in pieces(texts):
            columns = list(zip(*function(piece), strict=True))
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)]
            chunks.append(pa.StructArray.from_arrays(arrays, fields=list(kind)))
        return pa.concat_arrays(chunks) if chunks else pa.array([], kind)

    return apply
