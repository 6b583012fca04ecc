"""Compression of vectors to codes: one codebook for each part of a vector, by Lloyd rounds with Hamerly's bounds.

Every part of every row keeps one upper bound (distance to its entry) and one lower bound (distance to the
second-nearest entry). When entries move, bounds move with them; only where the upper one is not strictly below the
lower one, and not strictly below half the gap between its entry and the nearest other one, are all entries compared
again, in whole numbers. Bounds are rounded outwards, so a strict comparison proves that the nearest entry is unique,
and ties, which never pass it, go to the lower index in the scan.

The state (whole numbers, entries, bounds) is a table in the shared folder after each pass. Only sums by part and entry
and the codebooks, whose size is entries x dimension, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, keep, release, salted_join, send
from tessera.llm.vectors import lists, matrix, whole_vectors

#: Parts of a vector, entries of a part's codebook, rounds of assignment and update.
PARTS, ENTRIES, ROUNDS = 16, 64, 2

STATE = "vec_id long, {label}whole array<int>, entry array<int>, upper array<double>, lower array<double>"


def cuts(d: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends: equal parts, or as equal as they can be."""
    return [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and entries."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lower of equal ones), and outward bounds on its and the second one's distance."""
    far = _squares(x, book)
    entry = far.argmin(1)
    at = np.arange(len(x))
    upper = _up(np.sqrt(far[at, entry].astype(np.float64)))
    if far.shape[1] == 1:
        return entry, upper, np.full(len(x), np.inf)
    far[at, entry] = np.iinfo(np.int64).max
    return entry, upper, np.maximum(0, _down(np.sqrt(far.min(1).astype(np.float64))))


class Moves:
    """What a part's update does to bounds: how far entries moved, and half the gap to each one's nearest other entry."""

    def __init__(self, old: np.ndarray, new: np.ndarray) -> None:
        moved = _up(np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)))
        self.own = np.where((new == old).all(1), 0.0, moved)
        first = int(self.own.argmax())
        self.others = np.full(len(new), self.own[first])  # the largest move among the other entries
        self.others[first] = np.delete(self.own, first).max(initial=0.0)
        gaps = _squares(new, new).astype(np.float64)
        np.fill_diagonal(gaps, np.inf)
        self.half = _down(np.sqrt(gaps.min(1)) / 2) if len(new) > 1 else np.full(1, np.inf)


def follow(x: np.ndarray, book: np.ndarray, moves: Moves, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and bounds after a part's update, and how many rows were scanned for them."""
    upper, lower = _up(upper + moves.own[entry]), _down(lower - moves.others[entry])
    entry = entry.copy()
    proof = np.maximum(lower, moves.half[entry])
    at = np.flatnonzero(~(upper < proof))
    upper[at] = _up(np.sqrt(((x[at] - book[entry[at]]) ** 2).sum(1).astype(np.float64)))
    at = at[~(upper[at] < proof[at])]
    if len(at):
        entry[at], upper[at], lower[at] = scan(x[at], book)
    return entry, upper, lower, len(at)


def _assign(held, d: int, parts: int, columns: list[str]):
    """A pass over the rows: entries and bounds of each part, by a scan at first and by bounds afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moves = held()
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column("whole"), d).astype(np.int64)
            entry, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
            if moves:
                entry, upper, lower = matrix(batch.column("entry"), parts).astype(np.int64), matrix(batch.column("upper"), parts).copy(), matrix(batch.column("lower"), parts).copy()
            for p, (a, b) in enumerate(cuts(d, parts)):
                if moves:
                    entry[:, p], upper[:, p], lower[:, p], _ = follow(x[:, a:b], books[p], moves[p], entry[:, p], upper[:, p], lower[:, p])
                else:
                    entry[:, p], upper[:, p], lower[:, p] = scan(x[:, a:b], books[p])
            made = [lists(entry.astype(np.int32), pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, "entry", "upper", "lower"])

    return run


def _sums(d: int, parts: int, entries: int):
    """Of a task's rows: how many parts each entry has, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(b - a for a, b in cuts(d, parts))
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in batches:
            x, entry = matrix(batch.column("whole"), d).astype(np.int64), matrix(batch.column("entry"), parts)
            for p, (a, b) in enumerate(cuts(d, parts)):
                count[p] += np.bincount(entry[:, p], minlength=entries)
                np.add.at(total[p, :, : b - a], entry[:, p], x[:, a:b])
        part, at = np.nonzero(count)
        yield pa.record_batch({"part": part.astype(np.int32), "entry": at.astype(np.int32), "n": count[part, at], "sums": lists(total[part, at], pa.int64())})

    return run


def _update(state: DataFrame, books: list[np.ndarray], d: int) -> list[np.ndarray]:
    """Each entry as the componentwise floor of its parts' mean; entries without parts stay."""
    parts, entries = len(books), len(books[0])
    wide = max(b - a for a, b in cuts(d, parts))
    rows = state.select("whole", "entry").mapInArrow(_sums(d, parts, entries), "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[j].cast("decimal(28,0)")).alias(f"s{j}") for j in range(wide)]
    out = [b.copy() for b in books]
    for part, entry, n, *sums in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():
        out[part][entry] = [int(s) // n for s in sums[: out[part].shape[1]]]
    return out


def _seeds(rows: DataFrame, d: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the rows with the smallest ids; of a repeated id the least vector."""
    ids = [r[0] for r in rows.filter("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    first = rows.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("whole").alias("whole")).collect() if ids else []
    whole = np.array([r["whole"] for r in sorted(first)], np.int64).reshape(len(first), d)
    return [whole[:, a:b].copy() for a, b in cuts(d, parts)]


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, embedding) to rows (vec_id, label, entry array<int>, error long), and each part's codebook.

    Rows that whole_vectors drops have no code. Codebooks start as the parts of the smallest vec_ids (of a repeated id
    the least vector; rows without id are coded, but never start a codebook); with fewer ids they have fewer entries.
    Repeated rows count as often as they stand there. Parts are equal, or as equal as the dimension allows. Without rows
    that have an id there are no codebooks and no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows, d = whole_vectors(vectors)
    rows = keep(rows, "codes-whole")
    books = _seeds(rows, d, parts, entries)
    label = rows.schema["label"].dataType.simpleString()
    if not len(books[0]):
        return spark.createDataFrame([], f"vec_id long, label {label}, entry array<int>, error long"), books
    columns, schema = ["vec_id", "label", "whole"], STATE.format(label=f"label {label}, ")
    state, moves = rows, None
    for _ in range(rounds):
        before, state = state, keep(state.mapInArrow(_assign(send(spark, (books, moves)), d, parts, columns), schema), "codes-state")
        release(before)
        new = _update(state, books, d)
        books, moves = new, [Moves(a, b) for a, b in zip(books, new, strict=True)]
    last = state.mapInArrow(_assign(send(spark, (books, moves)), d, parts, columns), schema)
    held = send(spark, books)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held()
        for batch in batches:
            x, entry = matrix(batch.column("whole"), d).astype(np.int64), matrix(batch.column("entry"), parts)
            error = sum(((x[:, a:b] - books[p][entry[:, p]]) ** 2).sum(1) for p, (a, b) in enumerate(cuts(d, parts)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("entry"), pa.array(error, pa.int64())], names=["vec_id", "label", "entry", "error"])

    return last.mapInArrow(errors, f"vec_id long, label {label}, entry array<int>, error long"), books


def book_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components' decimals by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) to vec_id, code, error, label_error, codebooks_sha256 for each row that has a code.

    code has two hex digits a part. label_error is the error summed over a label's rows, null labels together; it is
    null where the sum is no long. See fit_codes for nulls, ties, repeated rows and empty tables.
    """
    rows, books = fit_codes(vectors)
    rows = keep(rows.withColumns({"unlabelled": F.col("label").isNull(), "of": F.coalesce(F.col("label").cast("string"), F.lit(""))}), "codes-rows")
    total = F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)")
    by_label = rows.groupBy("unlabelled", "of").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n"))
    code = F.array_join(F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    joined = salted_join(rows, keep(by_label, "codes-labels"), ["unlabelled", "of"], held="n")
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


ORACLE = r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, w[part * (len(w) // 16) + 1:(part + 1) * (len(w) // 16)] AS v FROM kept, range(16) AS r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p
       WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{rounds}
z AS ({assign_last}),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last})
SELECT e.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM e JOIN kept USING (vec_id), s
"""
_ASSIGN = """SELECT vec_id, part, any_value(v) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT vec_id, part, v, entry, list_sum(list_transform(list_zip(v, c), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT AS d FROM p JOIN {book} USING (part)
) GROUP BY vec_id, part"""
_ROUND = """a{k} AS ({assign}),
u{k} AS (SELECT part, entry, list(m ORDER BY j) AS c FROM (
  SELECT part, entry, j, floor(sum(v[j])::DOUBLE / count(*))::BIGINT AS m FROM a{k}, range(1, 1025) AS g(j) WHERE j <= len(v) GROUP BY part, entry, j
) GROUP BY part, entry),
c{k} AS (SELECT part, entry, coalesce(u.c, b.c) AS c FROM c{before} b LEFT JOIN u{k} u USING (part, entry)),"""
ORACLE = ORACLE.replace("{rounds}", "\n".join(_ROUND.format(k=k, before=k - 1, assign=_ASSIGN.format(book=f"c{k - 1}")) for k in range(1, ROUNDS + 1)))
ORACLE = ORACLE.replace("{assign_last}", _ASSIGN.format(book=f"c{ROUNDS}")).replace("{last}", str(ROUNDS))
