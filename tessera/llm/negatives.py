"""Hard-negative mining by inner product, with an orthogonal PCA rotation that discards most pairs early.

Whole-number vectors are rotated onto the eigenvectors of their second moments, which keeps inner products. The leading
components' products are added up first; what the remaining ones can add is at most the product of both residual
norms, plus slack for rounding. A pair that can't reach what its anchor still needs is dropped there; the others
get more components, and those left are scored exactly in whole numbers. The rotation therefore never decides a result.

Rows lie in shards in the shared folder, anchors in blocks. A task takes one block and a run of shards and keeps each
anchor's best so far, which is what pairs are measured against. Two such passes find the positives, and the
negatives between a share of a positive's score and that score. A run gives a bounded number of rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, keep, scratch, send
from tessera.llm.vectors import lists, matrix, whole_vectors

#: Positives of an anchor; negatives of an anchor and a positive; hundredths of the positive's score that they reach.
POSITIVES, NEGATIVES, PERCENT = 5, 5, 80
#: Anchors in a block, rows of a shard that are read at a time, rows that a task reads at most if there are more tasks.
BLOCK, CHUNK, RUN = 1024, 4096, 1 << 24
#: Pairs of an anchor and a row that are held at a time, as each may have to be scored exactly.
PAIRS = 1 << 16
#: Rows a shard has, and fewer where there are not enough shards for all tasks.
SHARD = 1 << 17
#: Shares of the components after which pairs are dropped.
STEPS = (8, 4, 2)
#: Rounding of a rotated product, as a share of both norms: far above d * 2**-53 for any dimension in use.
SLACK = 1e-9


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class Rotated:
    """Whole-number vectors with their rotated components, and the norms of what follows each step."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray) -> None:
        self.whole = whole
        self.turned = whole.astype(np.float64) @ turn
        d = turn.shape[0]
        self.steps = sorted({max(1, d // s) for s in STEPS}) if d else []
        tail = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {s: np.sqrt(tail[:, s]) if s < d else np.zeros(len(whole)) for s in self.steps}
        self.norm = np.sqrt((whole.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)


def pairs_reaching(a: Rotated, b: Rotated, need: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a and b that are allowed and whose inner product is at least need of a's row, with that product."""
    left = right = np.zeros(0, np.int64)
    partial, done = np.zeros(0), 0
    for k, s in enumerate(a.steps):
        if not k:
            dense = a.turned[:, :s] @ b.turned[:, :s].T
            most = dense + a.rest[s][:, None] * b.rest[s][None, :] + SLACK * a.norm[:, None] * b.norm[None, :] + 1e-6
            left, right = np.nonzero(allowed & (most >= need[:, None]))
            partial = dense[left, right]
        else:
            partial = partial + np.einsum("ij,ij->i", a.turned[left, done:s], b.turned[right, done:s])
            most = partial + a.rest[s][left] * b.rest[s][right] + SLACK * a.norm[left] * b.norm[right] + 1e-6
            stay = most >= need[left]
            left, right, partial = left[stay], right[stay], partial[stay]
        done = s
    score = np.einsum("ij,ij->i", a.whole[left], b.whole[right])
    stay = score >= need[left]
    return left[stay], right[stay], score[stay]


LEAST, GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The best rows so far of each slot: highest score first, ties by smaller id."""

    def __init__(self, slots: int, size: int) -> None:
        self.slots, self.size = slots, size
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        slot, score, row_id = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, row_id]
        order = np.lexsort((row_id, -score, slot))
        place = np.arange(len(order)) - np.searchsorted(slot[order], slot[order])
        order = order[place < self.size]
        self.slot, self.score, self.id = slot[order], score[order], row_id[order]

    def need(self) -> np.ndarray:
        """What a row must reach to enter each slot: the last score of a full one."""
        out = np.full(self.slots, LEAST)
        full = np.bincount(self.slot, minlength=self.slots) == self.size
        out[full] = self.score[np.searchsorted(self.slot, np.flatnonzero(full), side="right") - 1]
        return out


def _moments(d: int):
    """Of a task's rows: the sums of products of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = matrix(batch.column(0), d).astype(np.float64)
            total += x.T @ x
        yield pa.record_batch({"at": np.arange(d, dtype=np.int32), "sums": lists(total, pa.float64())})

    return run


def _added(table: pa.Table) -> pa.Table:
    sums = np.vstack([matrix(c, len(c[0])) for c in table.column("sums").chunks]).sum(0)
    return pa.table({"at": table.column("at")[:1].cast(pa.int32()), "sums": lists(sums[None, :], pa.float64())})


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Orthonormal columns, the one with the largest second moment first. Its d x d numbers pass through the driver."""
    parts = rows.select("whole").mapInArrow(_moments(d), "at int, sums array<double>")
    total = np.array([r["sums"] for r in sorted(parts.groupBy("at").applyInArrow(_added, "at int, sums array<double>").collect())]).reshape(d, d)
    return np.linalg.eigh(total / max(1.0, np.abs(total).max(initial=0.0)))[1][:, ::-1]


def _search(held, d: int, runs: int, size: int, percent: int | None):
    """A block of anchors against its run of shards: the best rows of the anchor's own label, or of other labels by positive."""

    def run(own: pa.Table) -> pa.Table:
        own, (turn, uris) = own.combine_chunks(), held()
        ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
        a = Rotated(matrix(own.column("whole").chunk(0), d).astype(np.int64), turn)
        if percent is None:
            low, high = np.full((len(ids), 1), LEAST), np.full((len(ids), 1), GREATEST)
        else:
            high = matrix(own.column("scores").chunk(0), len(own.column("scores")[0]))
            # the least whole number that is at least percent hundredths; a slot without a positive takes nothing
            low = np.where(high == LEAST, GREATEST, -((-percent * np.maximum(high, LEAST // 200)) // 100))
        slots = low.shape[1]
        best, few = Best(len(ids) * slots, size), max(1, PAIRS // len(ids))
        for uri in uris[own.column("run")[0].as_py() :: runs]:
            with _open(uri) as f:
                for batch in pq.ParquetFile(f).iter_batches(CHUNK, columns=["vec_id", "label", "whole"]):
                    for rows in (batch.slice(at, few) for at in range(0, batch.num_rows, few)):
                        other, b = rows.column(0).to_numpy(), Rotated(matrix(rows.column(2), d).astype(np.int64), turn)
                        same = labels[:, None] == rows.column(1).to_numpy()[None, :]
                        allowed = same & (ids[:, None] != other[None, :]) if percent is None else ~same
                        left, right, score = pairs_reaching(a, b, np.maximum(low, best.need().reshape(-1, slots)).min(1), allowed)
                        i, k = np.nonzero((score[:, None] >= low[left]) & (score[:, None] <= high[left]))
                        best.add(left[i] * slots + k, score[i], other[right[i]])
        at, k = np.divmod(best.slot, slots)
        return pa.table({"anchor_id": ids[at], "slot": k.astype(np.int32), "found_id": best.id, "score": best.score})

    return run


FOUND = "anchor_id long, slot int, found_id long, score long"


def _best(anchors: DataFrame, blocks: int, runs: int, size: int, search) -> DataFrame:
    """The best rows over all shards of each anchor and slot, with rank; anchors go out once for each run of shards."""
    dealt = anchors.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "run": F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))})
    found = dealt.repartition(blocks * runs, "block", "run").groupBy("block", "run").applyInArrow(search, FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT) -> DataFrame:
    """(vec_id, label, embedding) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of the same label; a positive's negatives are the best rows of other
    labels whose score is between percent hundredths of the positive's and the positive's. Labels are whole numbers.
    Rows without id or label, and those that whole_vectors drops, take no part. An id that stands in several rows is
    one row, the least by label and vector. Ties go to the smaller id. An anchor without positives, or a positive without negatives, has no
    row; neither has an empty table. Other columns, whatever their names, are neither read nor returned.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    whole, d = whole_vectors(vectors.withColumn("label", F.col("label").cast("long")))
    whole = whole.filter("vec_id IS NOT NULL AND label IS NOT NULL")
    n, most = whole.count(), spark.sparkContext.defaultParallelism
    folder = scratch(spark, "negatives")
    places = max(1, -(-n // SHARD), min(2 * most, n // 1024))
    single = whole.repartition(places, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "whole")).alias("least"))
    single.select("vec_id", "least.label", "least.whole").write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema("vec_id long, label long, whole array<int>").parquet(folder)
    anchors = keep(rows.filter(is_anchor), "negatives-anchors")
    uris = sorted(r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path").collect())
    blocks = max(1, -(-anchors.count() // BLOCK))
    runs = max(1, min(len(uris), max(-(-n // RUN), -(-2 * most // blocks))))
    held = send(spark, (rotation(rows, d), uris))
    own = keep(_best(anchors, blocks, runs, positives, _search(held, d, runs, positives, None)), "negatives-positives")
    scores = own.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("by_rank"))
    scores = scores.select(F.col("anchor_id").alias("vec_id"), F.array(*[F.coalesce(F.try_element_at("by_rank", F.lit(k + 1)), F.lit(LEAST).cast("long")) for k in range(positives)]).alias("scores"))
    other = _best(anchors.join(scores, "vec_id"), blocks, runs, negatives, _search(held, d, runs, negatives, percent))
    chosen = own.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = other.join(chosen, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """mine for anchors whose vec_id is divisible by 100, with the labels of every seventh id moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.w, b.w)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
