"""Vectors as columns, and blocks of them for searches of a query set against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most; a pair of blocks is what one group holds in memory.
BLOCK_ROWS = 32_768


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty and whose components are all finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def whole_numbers(vector: Column, scale: int) -> tuple[Column, Column]:
    """Whether the scaled length is below 2 ** 31, so that a long holds every inner product; and the floors of the scaled components."""
    # components first, so that no square overflows; the floor may lie up to one beyond the component
    short = F.forall(vector, lambda x: F.abs(x * scale) < 2.0**31) & (F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * scale) + 1, F.lit(2.0))) < 2.0**62)
    return short, F.transform(vector, lambda x: F.floor(x * scale).cast("long"))


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), dtype)
    return np.asarray(column.flatten(), dtype=dtype).reshape(len(column), -1)


def dealt(df: DataFrame, place: str, blocks: int, name: str) -> DataFrame:
    """A block number for each row by its place, so that equal ids and vectors spread as well."""
    return df.withColumn(name, F.pmod(F.xxhash64(place), F.lit(blocks)).cast("int"))


def copied(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """Each row once for every block of the other side."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def block_count(rows: int, parallel: int) -> int:
    """Blocks of at most BLOCK_ROWS rows, and enough of them for the cores at hand."""
    return max(1, -(-rows // BLOCK_ROWS), min(parallel, rows // 512))
