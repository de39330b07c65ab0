"""Vector columns as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int, largest: float, *others: str) -> tuple[DataFrame, int]:
    """(key, other columns, x) with x = floor(scale * vector) as array<long>, and the length of the vectors.

    A null vector, one with a null or non-finite component, and one with a
    component of ``largest`` or more in size is left out. If vectors differ in
    length, those of the most frequent length stay (of two as frequent, the
    longer one). One small aggregate runs; its table has a row per length, of
    which one reaches the driver. Without vectors the length is 0.
    """
    v = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < largest))
    x = F.transform(v, lambda c: F.floor(c * float(scale)))
    rows = df.where(sound).select(F.col(key).alias("key"), *[F.col(c).alias(f"other_{i}") for i, c in enumerate(others)], x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    length = first["length"] if first else 0
    return rows.where(F.size("x") == length), length


def matrix(batch: pa.RecordBatch, length: int, column: str = "x") -> np.ndarray:
    """A list column whose lists have one length, as an array with a row per list."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
