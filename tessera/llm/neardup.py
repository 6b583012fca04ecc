"""Near-duplicates by min-max hashing of five-word shingles, confirmed on full sets.

A document's shingle set is hashed under PERMUTATIONS permutations; the least and the greatest value of each are both
kept, which gives twice as many unbiased signature values as hash evaluations. Bands of values propose candidates,
full sets confirm them, and confirmed links are joined to components.

Equal sets are one representative from the start. A bucket never emits all its pairs: each round links its members to
one centre of the bucket, and members that are connected by then need no further comparison. What is left open after
ROUNDS rounds is joined on its rarest shingles under an exact bound, so no link between members of different
components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, dealt_join, forget, hot_keys, keep, pieces, release, salted_join, shared_dir

SHINGLE = 5
#: Hash functions, and signature values in a band: 2 * PERMUTATIONS / ROWS bands.
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Star rounds before the open rest is joined on its rare shingles.
ROUNDS = 2
CACHE = 600_000
#: Shingles hashed under all permutations at a time.
CHUNK = 16_384

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.Generator(np.random.PCG64(20))
_SCALE = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts as sorted arrays of 64-bit hashes."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        forget(self.known, CACHE)
        for w in set().union(*split) - self.known.keys():
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        get = self.known.__getitem__
        return [self._set(np.fromiter(map(get, x), np.uint64, len(x))) for x in split]

    @staticmethod
    def _set(words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        width = min(SHINGLE, len(words))
        n = len(words) - width + 1
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = _stir((out ^ words[k : k + n]) * _MIX + np.uint64(k))
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation: 2 * PERMUTATIONS values, so that neighbours in a band are of
    different permutations."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        x = shingles[at : at + CHUNK]
        h = x[None, :] * _SCALE[:, None] + _SHIFT[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    """One hash per band, different for equal values in different bands."""
    grid = values.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for k in range(ROWS):
        out = _stir((out ^ grid[:, k]) * _MIX)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, s1, s2 (hashes of the whole set), bands."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler()
        for batch in batches:
            for piece in pieces(batch, 1):
                sets = made.sets(piece.column(1).to_pylist())
                full = [s if len(s) else None for s in sets]
                s1 = [None if s is None else int(_signed(np.bitwise_xor.reduce(_stir(s), keepdims=True))[0]) for s in full]
                s2 = [None if s is None else int(_signed(np.add.reduce(_stir(s ^ _MIX), keepdims=True))[0]) for s in full]
                keys = [None if s is None else _signed(bands(signature(s))) for s in full]
                yield pa.record_batch({"doc_id": piece.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, text) to id, n, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler()
        for batch in batches:
            for piece in pieces(batch, 1):
                sets = made.sets(piece.column(1).to_pylist())
                yield pa.record_batch({"id": piece.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "shingles": pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "id long, n long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough; sizes alone rule out many.

    A text that stands in very many pairs, as a group's centre does, is dealt to many tasks on either side.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("id")) for x in ("a", "b")]))
    limit, hot = hot_keys(pairs.select(ends.alias("end")).groupBy("end.side", "end.id").agg(F.count(F.lit(1)).alias("n")))
    sized = pairs
    for x in ("a", "b"):
        mine = sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
        sized = dealt_join(sized, mine, [x], limit, [(k, n) for side, k, n in hot if side == x])
    sized = sized.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return sized.withColumn("both", both).filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * PERCENT).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Nodes of links (a, b) with the least id they are connected to: id, component.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller ones, are linked to
    the least node in its neighbourhood. Each step's links are checkpointed.
    """
    shared_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = small.checkpoint()
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        before = now


def _label(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (key, id) with each id's component, itself where it has no link."""
    return rows.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of buckets whose members are of two components or more."""
    per = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("held"))
    return salted_join(rows, per.filter("c0 <> c1").select("key", "held"), ["key"], held="held").drop("held")


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """A pair for each id: with the centre, of those of its buckets, that comes first in this turn's order."""
    rank = F.col("id") if turn == 0 else F.xxhash64(F.lit(turn), "id")
    centre = rows.groupBy("key").agg(F.min_by(F.struct(F.col("id").alias("z"), F.col("c").alias("cz")), rank).alias("x"), F.min(rank).alias("rank"), F.count(F.lit(1)).alias("held"))
    met = salted_join(rows, centre.select("key", "x.z", "x.cz", "rank", "held"), ["key"], held="held").filter("id <> z and c <> cz")
    return met.groupBy("id").agg(F.min_by("z", "rank").alias("z")).select(F.least("id", "z").alias("a"), F.greatest("id", "z").alias("b")).distinct()


def _prefix_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components among the texts of rows (key, id, c) that can be similar enough.

    Shingles are ordered from rare to frequent among these texts. Two sets of sizes n and m that are similar enough
    have an overlap of at least PERCENT / (100 + PERCENT) of n + m, so their first common shingle stands so early in
    both that what follows can still make up that overlap. Only shingles early enough are joined on; those that texts
    of a single component share are left out. The bound is exact: no link is lost, whatever a bucket's size.
    """
    nodes = keep(rows.groupBy("id").agg(F.min("c").alias("c")), "neardup-open")
    mine = keep(sets.join(nodes, "id").select("id", "c", "n", "shingles", F.xxhash64("shingles").alias("set")), "neardup-open-sets")
    flat = mine.select("id", "set", "c", "n", F.explode("shingles").alias("key"))
    spread = keep(flat.groupBy("key").agg(F.count(F.lit(1)).alias("df"), (F.min("c") != F.max("c")).alias("open")), "neardup-spread")
    order = Window.partitionBy("id", "set").orderBy("df", "key")
    early = salted_join(flat, spread, ["key"], held="df").withColumn("at", F.row_number().over(order))
    early = early.filter(F.col("open") & ((F.col("n") - F.col("at") + 1) * 100 >= F.col("n") * PERCENT))
    first = keep(early.select("key", "id", "c", "n", "at"), "neardup-first")
    early = keep(_open(first), "neardup-early")
    release(nodes, mine, spread, first)
    other = early.select("key", *[F.col(x).alias(f"{x}2") for x in ("id", "c", "n", "at")])
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1
    can = (F.col("id") < F.col("id2")) & (F.col("c") != F.col("c2")) & (most * (100 + PERCENT) >= (F.col("n") + F.col("n2")) * PERCENT)
    return salted_join(early, other, ["key"]).filter(can).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def linked(buckets: DataFrame, sets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Components of the confirmed links between members (key, id) of the same bucket: id, component."""
    links, found, rows = None, None, buckets.withColumn("c", F.col("id"))
    for turn in range(rounds + 1):
        pairs = keep(_star_pairs(rows, turn) if turn < rounds else _prefix_pairs(rows, sets), "neardup-pairs")
        got = confirm(pairs, sets)
        last = [pairs] if links is None else [pairs, links]
        links = keep(got if links is None else links.unionByName(got).distinct(), "neardup-links")
        found = components(links).checkpoint()
        release(*last)
        if turn < rounds:
            named = keep(_label(rows.drop("c"), found), "neardup-named")
            rows = keep(_open(named), "neardup-rows")
            release(named)
            if rows.isEmpty():
                break
    return found


def near_duplicates(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id, kept, for every row of docs.

    component_id is the least doc_id that is reachable over links, the row's own included. Null and empty texts have
    an empty set, which links with nothing. Rows of one doc_id are one node, whatever their texts, and kept together; a
    null doc_id is no node: its component_id is null and it is kept. Long texts are hashed whole. Other columns, whatever
    their names, are neither read nor returned. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keep(signatures(docs), "neardup-signatures")
    repeated = _repeats(rows)
    same = ["n_shingles", "s1", "s2"]
    node = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    full = rows.filter(node)
    equal = keep(full.groupBy(*same).agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"), F.count(F.lit(1)).alias("held")), "neardup-equal")
    flat = equal.select("id", F.explode("bands").alias("key"))
    shared = flat.groupBy("key").agg(F.min("id").alias("i0"), F.max("id").alias("i1"), F.count(F.lit(1)).alias("held")).filter("i0 <> i1").select("key", "held")
    shared = keep(shared, "neardup-shared")
    buckets = salted_join(flat, shared, ["key"], held="held").drop("held")
    buckets = keep(buckets.distinct() if repeated else buckets, "neardup-buckets")
    nodes = buckets.select("id").distinct()
    sets = shingle_sets(docs.withColumnRenamed("doc_id", "id").select("id", "text").join(nodes, "id", "left_semi"))
    # a doc_id of several rows has several sets; any of them may link it
    sets = keep(sets.distinct() if repeated else sets, "neardup-sets")
    found = linked(buckets, sets, rounds)
    release(shared, buckets, sets)
    # a component is found per set, then each row has that of its set
    named = _label(equal.select(*same, "id", "held"), found).drop("id")
    out = salted_join(full.select("doc_id", *same), named, same, held="held").select("doc_id", "n_shingles", F.col("c").alias("component_id"))
    out = out.unionByName(rows.filter(~node).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out = _one_node(keep(out, "neardup-out")) if repeated else out
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _one_node(rows: DataFrame) -> DataFrame:
    """rows (doc_id, n_shingles, component_id) where all components that a doc_id's rows are in become one."""
    met = rows.filter("doc_id is not null").select("doc_id", F.col("component_id").alias("c")).distinct()
    least = keep(met.groupBy("doc_id").agg(F.min("c").alias("a"), F.count(F.lit(1)).alias("n")), "neardup-least")
    ties = met.join(least.filter("n > 1").select("doc_id", "a"), "doc_id").filter("c <> a").select("a", F.col("c").alias("b"))
    merged = components(ties).select(F.col("id").alias("a"), F.col("component").alias("merged"))
    # a component of very many ids is one key of this join
    one = salted_join(least.select("doc_id", "a"), merged, ["a"], "left").select("doc_id", F.coalesce("merged", "a").alias("c"))
    nodes = salted_join(rows.filter("doc_id is not null"), keep(one, "neardup-one"), ["doc_id"]).select("doc_id", "n_shingles", F.col("c").alias("component_id"))
    return nodes.unionByName(rows.filter("doc_id is null"))


def _repeats(rows: DataFrame) -> bool:
    """Whether a doc_id stands in more than one row."""
    return not rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates of docs, with all columns: a row of the group's least doc_id.

    If that id has several rows, the one that comes first by a hash of all its columns stays; rows without doc_id are
    no duplicates and all stay, as do rows without words unless their doc_id repeats. Column names must differ; none
    clashes with the operator's. An empty table gives no rows.
    """
    gone = near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    twice = left.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    twice = keep(twice, "neardup-twice")
    # pre-aggregated where the rows are: one row per task and id is shuffled, however many rows an id has
    hashed = F.struct(*[F.xxhash64(F.lit(k), *docs.columns) for k in (1, 2)])
    one = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), hashed).alias("row"))
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))
