"""What the operators on vectors share: whole-number vectors of the rows that take part."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are multiplied by it before their floor is taken.
SCALE = 256
#: Inner products of whole-number vectors stay within it, so five times one is still a long.
MOST = 1 << 55


def whole_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, embedding) to (vec_id, label, whole) of the rows that have a vector, and its dimension.

    whole has floor(256 * x) for each component x. Rows whose vector is null or holds null or non-finite components are
    dropped. All vectors have the dimension that most rows have (the smaller of two), and rows of another one are
    dropped too. Components beyond what keeps an inner product below 2**55 (92,000 at 64 components) count as that.
    An empty table gives no rows and dimension 0. Other columns, whatever their names, are neither read nor returned.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).filter(F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), "d").first()
    d = first["d"] if first else 0
    most = isqrt(MOST // max(d, 1))
    clipped = F.transform("x", lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(v * SCALE))).cast("int"))
    return rows.filter(F.size("x") == d).select("vec_id", "label", clipped.alias("whole")), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of d numbers a row, without nulls, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(values.ravel(), kind))
