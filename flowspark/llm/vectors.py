"""Reading vector tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, not all zero, and at least one."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def common_width(vectors: DataFrame, column: str) -> int:
    """The length most vectors have, the smaller of equally frequent ones; 0 for an empty table."""
    row = vectors.groupBy(F.size(column).alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    return row["w"] if row else 0


def stacked(column) -> np.ndarray:
    """A column of equally long arrays as a matrix in double precision."""
    return np.array(column.tolist(), dtype=np.float64)
