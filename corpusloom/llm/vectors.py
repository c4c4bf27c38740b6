"""Vector columns: which rows take part, matrices of Arrow columns, tiles of two tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str) -> Column:
    """True for a vector that is not null and holds no null and no non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have `width` elements."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def numbers(column: pa.Array | pa.ChunkedArray, null: int | None = None) -> np.ndarray:
    """A column of numbers; `null` stands for null."""
    return (column if null is None else column.fill_null(null)).to_numpy()


def block_of(key: str, blocks: int) -> Column:
    """A block by a hash of a row's own number, so that equal rows are spread too."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def meeting(rows: DataFrame, own: str, other: str, key: str, blocks: int, others: int) -> DataFrame:
    """`rows` with its block in column `own`, once for each of the other table's blocks in column `other`."""
    return rows.withColumn(own, block_of(key, blocks)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def block_count(rows: int, least: int, most: int, cores: int) -> int:
    """Blocks of at most `most` rows; of fewer, down to `least`, as long as there would be less than four blocks a core."""
    size = min(most, max(least, -(-rows // (4 * cores))))
    return max(1, -(-rows // size))
