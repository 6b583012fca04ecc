"""Token overlap of two long texts by counting, in time proportional to their lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import bound_batches

#: Rows that are counted at one time.
ROWS = 200
COUNTS = ("n_a", "n_b", "same", "a_in_b")


def _counts(a: pa.ListArray, b: pa.ListArray) -> list[np.ndarray]:
    """COUNTS of each row, of arrays without nulls: tokens become numbers, and (row, token) are counted on either side."""
    n = [np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (a, b)]
    flat = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
    code, wide = flat.indices.to_numpy().astype(np.int64), max(1, len(flat.dictionary))
    row = [np.repeat(np.arange(len(x)), x) for x in n]
    left, x = np.unique(row[0] * wide + code[: n[0].sum()], return_counts=True)
    right = row[1] * wide + code[n[0].sum() :]
    # of b only what a row's a may hold is counted
    place = np.searchsorted(left, right)
    hit = place < len(left)
    hit[hit] = left[place[hit]] == right[hit]
    y = np.bincount(place[hit], minlength=len(left))
    sums = lambda v: np.bincount(left // wide, v, len(a)).astype(np.int64)
    return [n[0], n[1], sums(np.minimum(x, y)), sums(np.where(y > 0, x, 0))]


def overlaps(rows: DataFrame, *ids: str) -> DataFrame:
    """(ids, a array<string>, b array<string>) to ids, n_a, n_b, same, a_in_b: lengths, the multiset overlap, and how many
    of a's tokens, repeats counted, stand in b.

    Tokens are counted where the row is, a few rows at a time, so nothing is shuffled, and no array is searched for each
    token of another. Null arrays are empty, null tokens are left out; repeated rows are rows of their own.
    """
    bound_batches(rows.sparkSession)
    full = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t.isNotNull()).alias(c)
    held = rows.select(*ids, full("a"), full("b"))
    schema = T.StructType([*[held.schema[c] for c in ids], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                made = _counts(batch.column(len(ids)), batch.column(len(ids) + 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], *map(pa.array, made)], names=schema.names)

    return held.mapInArrow(run, schema)


def f1(over: DataFrame):
    """2 * same / (n_a + n_b); both empty is 1, one empty 0."""
    return F.when(over.n_a + over.n_b == 0, F.lit(1.0)).otherwise(2 * over.same / F.greatest(over.n_a + over.n_b, F.lit(1)))


def recall(over: DataFrame):
    """Share of a's tokens that stand in b; 0 without any."""
    return F.when(over.n_a == 0, F.lit(0.0)).otherwise(over.a_in_b / F.greatest(over.n_a, F.lit(1)))
