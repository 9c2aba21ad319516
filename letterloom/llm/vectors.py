"""What the vector operators share: which vectors take part, and classes of equal vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def with_validity(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``vec``, ``cls`` and ``also`` (two hashes that name the vector together) and ``valid`` for every row: not
    null, not all zero, all components finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(~bad & some, F.lit(False)))
    return rows.withColumn("cls", F.xxhash64("vec")).withColumn("also", F.xxhash64(F.lit(1), F.reverse("vec")))


def lengths(rows: DataFrame) -> dict[int, int]:
    """How many vectors of each length ``vec`` there are; only vectors of one length can be compared."""
    return {int(d): int(n) for d, n in rows.groupBy(F.size("vec")).count().collect()}


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
