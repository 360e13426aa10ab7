"""Integer vectors out of embedding rows, shared by the operators that compare in whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this would not add up exactly in 64 bits; they raise an error instead of a wrong result.
LARGEST = 1 << 24


def finite(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number; never null."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as int."""
    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) <= LARGEST, y).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).cast("int")

    return F.transform(vector, whole)


def matrix(column, width: int) -> np.ndarray:
    """Rows of an array column of one length, as 64-bit integers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.int64).reshape(-1, width)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as an array column."""
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.reshape(-1), kind))


def floor_means(sums: DataFrame, keys: list[str], width: int) -> dict[tuple, list[int]]:
    """Per key the componentwise floor(sum / count) of sums(keys, n, total array<long>); as many rows as there are centroids."""
    added = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
    return {tuple(r[k] for k in keys): [r[f"s{i}"] // r.n for i in range(width)] for r in added.collect()}
