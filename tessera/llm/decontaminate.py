"""Benchmark decontamination by spaced seeds.

Each mask selects some positions of a run of words and ignores the others; equal hashes of the selected words in a
document and a benchmark item are a hit whatever stands at the ignored positions. Around a hit the two are compared
word by word along the hit's diagonal, and the best-scoring stretch, which may span substituted words, is an overlap.
Overlaps of neighbouring diagonals add up, so a word that is inserted or dropped splits none. An item shorter than a
mask is a leak only where all its words stand in a row. The benchmark is the fixed side: it is indexed in blocks of a
bounded number of words, and every document passes by each block's index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import OWN, annotate, forget, keep, send

#: Selected (1) and ignored (0) words. An item shorter than a mask isn't indexed under it.
MASKS = ("11111111", "110111011", "1101011011", "11001011101")
#: Words of an item below which it is found only whole and in a row.
MIN_ITEM = 8
#: Words by which neighbouring diagonals may differ to add up.
MAX_SHIFT = 10
#: Matching words that an overlap needs, or this share of a shorter item's words.
MIN_MATCH, MIN_SHARE = 13, 0.6
#: What a differing word costs against a matching word's 1.
MISMATCH = 2
#: Words of benchmark items indexed at a time, which bounds a block's index to about 60 MB.
BLOCK_WORDS = 500_000
#: Hits that are looked at together.
HITS = 1 << 20
CACHE = 600_000

#: Typographic apostrophes count as ASCII ones. Fixed values.
_QUOTES = str.maketrans(dict.fromkeys("\u2018\u2019\u02bc\u00b4\u2032", "'"))
#: ASCII upper case to lower case, all ASCII other than letters and digits to blanks.
_FOLD = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256)).lower()
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Hashes of texts' words: lower case, punctuation apart."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").translate(_QUOTES).lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() for t in texts]
        forget(self.known, CACHE)
        for w in set().union(*split) - self.known.keys():
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        get = self.known.__getitem__
        return [np.fromiter(map(get, x), np.uint64, len(x)) for x in split]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected words from each position on."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ (words[k : k + n] + np.uint64(k + 1))) * _MIX
            out ^= out >> np.uint64(29)
    return out


@dataclass
class Index:
    """Seeds of a block of items, per mask sorted with item and offset, and a table that most others miss. Items that
    are shorter than MIN_ITEM have one seed, of all their words, under a mask of their own length."""

    ids: list[int]
    items: list[np.ndarray]
    tables: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, ids: list[int], items: list[np.ndarray]) -> Index:
        tables = []
        short = sorted({len(w) for w in items if len(w) < MIN_ITEM})
        for mask in (*MASKS, *("1" * n for n in short)):
            made = [seeds(w, mask) if (len(w) >= MIN_ITEM) == (len(mask) >= MIN_ITEM) and (len(w) == len(mask) or len(w) >= MIN_ITEM) else seeds(w[:0], mask) for w in items]
            keys = np.concatenate(made) if made else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(made)), [len(m) for m in made])
            offset = np.concatenate([np.arange(len(m)) for m in made]) if made else np.zeros(0, np.int64)
            order = np.argsort(keys, kind="stable")
            bits = max(16, int(len(keys) * 16).bit_length())
            present = np.zeros(1 << bits, bool)
            present[keys & np.uint64((1 << bits) - 1)] = True
            tables.append((mask, keys[order], item[order], offset[order], present))
        return cls(ids, items, tables)

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions in words, items and offsets in them of equal seeds, at most about HITS at a time."""
        for mask, keys, item, offset, present in self.tables:
            made = seeds(words, mask)
            at = np.flatnonzero(present[made & np.uint64(len(present) - 1)])
            low, high = np.searchsorted(keys, made[at]), np.searchsorted(keys, made[at], side="right")
            at, low, n = at[low < high], low[low < high], (high - low)[low < high]
            upto = np.cumsum(n)
            done = 0
            while done < len(at):
                stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + HITS, side="right")))
                row = np.repeat(np.arange(done, stop), n[done:stop])
                k = low[row] + np.arange(len(row)) - np.repeat(upto[done:stop] - n[done:stop] - (upto[done - 1] if done else 0), n[done:stop])
                yield at[row], item[k], offset[k]
                done = stop


def overlap(item: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The best stretch of item laid on words from position shift, which may be negative: matching words, and the first
    place in item and the one behind the last."""
    a, b = max(0, -shift), min(len(item), len(words) - shift)
    same = item[a:b] == words[a + shift : b + shift]
    sums = np.r_[0, np.cumsum(np.where(same, 1, -MISMATCH))]
    run = sums - np.minimum.accumulate(sums)
    last = int(run.argmax())
    if not run[last]:
        return 0, a, a
    first = int(np.flatnonzero(run[:last] == 0)[-1])
    return int(same[first:last].sum()), a + first, a + last


def chained(parts: list[tuple[int, int, int, int]]) -> int:
    """Most matching words of stretches (matched, first, end, shift) of one item, one a shift, that follow each other in
    item and text, neighbours at most MAX_SHIFT apart in shift; where two overlap, the later one's lost words don't
    count. A stretch has few neighbours, so this takes time in proportion to their number."""
    best: list[int] = []
    parts = sorted(parts, key=lambda p: (p[1], p[2], p[3]))
    at = {p[3]: k for k, p in enumerate(parts)}
    for k, (matched, first, end, shift) in enumerate(parts):
        top = matched
        for s in range(shift - MAX_SHIFT, shift + MAX_SHIFT + 1):
            j = at.get(s, k)
            if j >= k:
                continue
            _, f, e, _ = parts[j]
            lost = max(0, e - first, e + s - first - shift)
            if f < first and e < end and f + s < first + shift and e + s < end + shift and lost < matched:
                top = max(top, best[j] + matched - lost)
        best.append(top)
    return max(best, default=0)


def leaks_of(index: Index, hashed: list[np.ndarray]) -> list[dict[int, int]]:
    """For each text, given by its words' hashes, the items that it overlaps, with the number of matching words."""
    sizes = np.array([len(h) for h in hashed], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    # a text's diagonals with an item, each once: number of the pair and shift as one number
    longest = max((len(w) for w in index.items), default=0)
    span = len(flat) + longest + 1
    diagonals = np.zeros(0, np.int64)
    for q, item, offset in index.hits(flat):
        doc = np.searchsorted(ends, q, side="right")
        shift = q - (ends - sizes)[doc] - offset
        diagonals = np.union1d(diagonals, (doc * len(index.items) + item) * span + shift + longest)
    pair, shift = np.divmod(diagonals, span)
    shift -= longest
    found: list[dict[int, int]] = [{} for _ in hashed]
    edges = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True]) if len(pair) else [0]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        doc, item = divmod(int(pair[low]), len(index.items))
        words = index.items[item]
        n = len(words)
        parts = [(*overlap(words, hashed[doc], s), s) for s in shift[low:high].tolist()]
        need = n if n < MIN_ITEM else min(MIN_MATCH, MIN_SHARE * n)
        matched = max(p[0] for p in parts)
        if matched < need and n >= MIN_ITEM and len(parts) > 1:
            matched = chained(parts)
        if matched >= need:
            found[doc][item] = matched
    return found


def _make(index: Index) -> Callable[[], Callable[[list], list]]:
    def make() -> Callable[[list], list]:
        words = Words()

        def call(texts: list) -> list:
            hashed = words.hashes(texts)
            got = [sorted((index.ids[i], m) for i, m in f.items()) for f in leaks_of(index, hashed)]
            return [[len(h) for h in hashed], [sorted({i for i, _ in g}) for g in got], [max((m for _, m in g), default=0) for g in got]]

        return call

    return make


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes of the benchmark's items, block by block; items without id or words are left out."""
    words, ids, items, size = Words(), [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        made = words.hashes([text])[0]
        if not len(made):
            continue
        ids.append(item_id)
        items.append(made)
        size += len(made)
        if size >= block_words:
            yield Index.build(ids, items)
            ids, items, size = [], [], 0
    if ids:
        yield Index.build(ids, items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with __tsr_n_words, __tsr_items (sorted ids of the items that it overlaps) and __tsr_matched (most matching
    words of one of them).

    Null and empty texts, and any text with an empty benchmark, have no items; long texts are searched whole. Items of
    equal text are all named, and an id with several texts if one of them overlaps. Each row of docs stands for itself.
    All columns of docs stay; only columns of these three names are replaced. An empty table gives no rows.

    If the benchmark has more than one block, docs are written once a block, so that an executor holds one index at a
    time.
    """
    spark = docs.sparkSession
    own = {c: f"{OWN}{c}" for c in ("n_words", "items", "matched")}
    fields = [T.StructField(own["n_words"], T.LongType()), T.StructField(own["items"], T.ArrayType(T.LongType())), T.StructField(own["matched"], T.LongType())]
    docs, out = docs.drop(*own.values()), None
    for index in blocks(benchmark, block_words) if not benchmark.isEmpty() else ():
        sent = send(spark, index)
        if out is None:
            out = annotate(docs, text_col, lambda sent=sent: _make(sent())(), fields)
            continue
        before = keep(out, "leaks").select(*docs.columns, F.struct(*own.values()).alias(f"{OWN}before"))
        more, old = annotate(before, text_col, lambda sent=sent: _make(sent())(), fields), F.col(f"{OWN}before")
        items, matched = F.array_sort(F.array_union(own["items"], old[own["items"]])), F.greatest(own["matched"], old[own["matched"]])
        out = more.select(*docs.columns, own["n_words"], items.alias(own["items"]), matched.alias(own["matched"]))
    if out is None:
        out = annotate(docs, text_col, lambda: _make(Index.build([], []))(), fields)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, contaminated, n_items, items, matched for every row of docs.

    Null and empty texts have no words and no items, as any text has with an empty benchmark; long texts are searched
    whole. Repeated rows, and rows without id, stand for themselves; items with equal text are all named. Other columns,
    whatever their names, are neither read nor returned. An empty table gives no rows.
    """
    rows = find_leaks(docs.select("doc_id", "text"), benchmark)
    items = F.col(f"{OWN}items")
    return rows.select("doc_id", F.col(f"{OWN}n_words").alias("n_words"), (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.col(f"{OWN}matched").alias("matched"))
