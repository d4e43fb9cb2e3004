"""What the operators on embedding vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector has neither null nor non-finite components; false for a null one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the vectors that are finite and, if dim is given, have as many components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    if rows.schema["embedding"].dataType.elementType.typeName() not in ("float", "double"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    keep = finite(F.col("embedding"))
    return rows.where(keep if dim is None else (F.size("embedding") == dim) & keep)


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as doubles, `width` in each row: shorter lists end in zeros, longer ones are cut."""
    flat, lengths = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64), rows.value_lengths().to_numpy()
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    at = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at[place < width], place[place < width]] = flat[place < width]
    return out
