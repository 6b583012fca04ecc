"""Removal of repeated word windows: recurring passages confirmed, compiled into automata and located everywhere.

A window is WINDOW consecutive words of one document; words go that a window covers whose words also start in a
document with a smaller id. Every window has one trigger, the least hash among its GRAM-word runs, so equal windows
have equal triggers. Neighbouring windows of one trigger are a phrase. A trigger that stands in documents of one id only
can't hold a repeat, and its phrases never move.

The phrases of the other triggers are cut from all documents, once a shard, and go to the shard of automata that owns
their trigger. There windows that stand in documents of different ids are confirmed word by word and compiled, as
passages, into an Aho-Corasick automaton over word numbers, and all phrases sent there are streamed through it, which
locates every occurrence of every confirmed window. What it locates goes back to the documents' shards as places in phrases with the
smallest id that has the window. A trigger with more than IN_TASK phrases, as a common line in very many contexts makes,
has its windows sent instead, each to the automaton that owns the window, once a shard. So a group is bounded
by IN_TASK phrases or by the number of shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, keep, scratch
from tessera.llm.repeats import _groups, _least, _powers, _stir, _system

#: Words of a window, and of the runs whose hashes are triggers.
WINDOW, GRAM = 13, 7
#: Bytes, or words, hashed together; longer texts are cut into stretches.
STRETCH = 1 << 20
#: Phrases of a trigger, over all shards, that meet in one automaton.
IN_TASK = 1000
#: Bytes of phrases that are compiled into one automaton; its root is searched in line, so larger ones take longer.
COMPILED = 1 << 19
#: Distinct phrases of a shard that are held as Python objects.
HELD = 100_000

_RANDOM = np.random.Generator(np.random.PCG64(12))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class _Sums:
    """Rolling hashes of a sequence of 64-bit values, from prefix sums of values times powers modulo 2**64."""

    power = inverse = np.zeros(0, np.uint64)

    def __init__(self, values: np.ndarray) -> None:
        if len(values) >= len(_Sums.power):
            _Sums.power, _Sums.inverse = _powers(_BASE, len(values) + 1), _powers(_INVERSE, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=self.sums[1:])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.inverse[begin]

    def every(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n]


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes begin and end."""
    blank = np.r_[True, _BLANK[data], True]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, which is the same wherever it stands."""
    out, done = np.empty(len(begin), np.uint64), 0
    while done < len(begin):
        upto = max(done + 1, int(np.searchsorted(end, begin[done] + STRETCH, side="right")))
        low, high = int(begin[done]), int(end[upto - 1])
        sums = _Sums(_BYTE[data[low:high]])
        out[done:upto] = _stir(sums.at(begin[done:upto] - low, end[done:upto] - low) + (end[done:upto] - begin[done:upto]).astype(np.uint64), 4)
        done = upto
    return out


@dataclass
class Text:
    """Some documents' words: as bytes with one blank after each, where each begins there, hashes, and where documents' words begin."""

    data: bytes
    begin: np.ndarray
    hashed: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, raws: list[bytes]) -> Text:
        data = np.frombuffer(b"".join(r + b" " for r in raws), np.uint8)
        begin, end = split(data)
        stops = np.cumsum([0, *(len(r) + 1 for r in raws)])
        first = np.searchsorted(begin, stops)
        # each word with the blank behind it
        blank = _BLANK[data]
        kept = ~blank
        kept[end] = True
        data = np.where(blank, np.uint8(0x20), data)[kept]
        size = end - begin
        begin = np.cumsum(size + 1) - size - 1
        return cls(data.tobytes(), np.r_[begin, len(data)], _hashes(data, begin, begin + size), first)

    def words(self, first: int, n: int) -> bytes:
        """n words from the given one on, one blank between them."""
        return self.data[self.begin[first] : self.begin[first + n] - 1]


@dataclass
class Parse:
    """Phrases: trigger, mark, number of the document in the text, first word, number of windows."""

    trigger: np.ndarray
    mark: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    windows: np.ndarray


def parse(text: Text) -> Parse:
    out = [[np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3]
    total = len(text.hashed)
    for low in range(0, max(0, total - WINDOW + 1), STRETCH):
        sums = _Sums(text.hashed[low : low + STRETCH + WINDOW - 1])
        grams = _stir(sums.every(GRAM), 1)
        trigger = _least(grams, WINDOW - GRAM + 1)
        n = len(trigger)
        doc = np.searchsorted(text.first, np.arange(low, low + n), side="right") - 1
        whole = text.first[doc + 1] - np.arange(low, low + n) >= WINDOW
        # a window that begins at its trigger is the last one with it, whether or not the next trigger is equal
        fresh = np.r_[True, (trigger[1:] != trigger[:-1]) | (grams[: n - 1] == trigger[:-1]) | (doc[1:] != doc[:-1])]
        begin = np.flatnonzero(fresh & whole)
        stop = np.minimum(np.r_[np.flatnonzero(fresh), n][np.searchsorted(np.flatnonzero(fresh), begin) + 1], text.first[doc[begin] + 1] - low - WINDOW + 1)
        mark = _stir(sums.at(begin, stop + WINDOW - 1) + (stop - begin).astype(np.uint64), 2)
        out.append([trigger[begin], mark, doc[begin], begin + low, stop - begin])
    return Parse(*(np.concatenate(c) for c in zip(*out, strict=True)))


def window_keys(hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and mark of the windows that begin at the given words: two hashes of their words."""
    one, two = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    for k in range(WINDOW):
        w = hashed[first + k]
        one, two = one * np.uint64(_BASE) + w, two * np.uint64(_SECOND) + _stir(w, 7)
    return _stir(one, 3), _stir(two, 5)


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first on, n of them, and the row that each belongs to."""
    row = np.repeat(np.arange(len(first)), n)
    return first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), row


# ---- shards


def _texts(uri: str, least: int = STRETCH) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 bytes of a shard's documents, some at a time. Documents without id come too."""
    system, path = _system(uri)
    ids, raws, size = [], [], 0
    with system.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(200):
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                raws.append(raw or b"")
                size += len(raws[-1])
                if size >= least:
                    yield ids, raws
                    ids, raws, size = [], [], 0
    if ids:
        yield ids, raws


def _named(ids: list, found: Parse) -> tuple[Parse, np.ndarray]:
    """The phrases of documents that have an id, and those ids."""
    known = np.array([i is not None for i in ids], bool)[found.doc]
    found = Parse(*(getattr(found, c)[known] for c in Parse.__dataclass_fields__))
    return found, np.array([i or 0 for i in ids], np.int64)[found.doc]


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each of x whether it is among some sorted values."""
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x if len(among) else np.zeros(len(x), bool)


def _least_and_most(order: np.ndarray, fresh: np.ndarray, *values: tuple[np.ndarray, np.ufunc]) -> list[np.ndarray]:
    starts = np.flatnonzero(fresh)
    return [by.reduceat(v[order], starts) if len(starts) else v[:0] for v, by in values]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's triggers, with the least and the greatest id that has it and how many phrases do."""
    for batch in batches:
        for shard, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held: list[tuple] = []
            for ids, raws in _texts(uri):
                found, doc_id = _named(ids, parse(Text.of(raws)))
                held.append((found.trigger, found.mark, doc_id, doc_id))
            trigger, mark, low, high = (np.concatenate(c) for c in zip(*held, strict=True)) if held else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
            order, fresh = _groups(trigger, mark)
            low, high = _least_and_most(order, fresh, (low, np.minimum), (high, np.maximum))
            trigger = trigger[order[fresh]]
            order, fresh = _groups(trigger)
            low, high, n = _least_and_most(order, fresh, (low, np.minimum), (high, np.maximum), (np.ones(len(trigger), np.int64), np.add))
            yield pa.record_batch({"trigger": trigger[order[fresh]].view(np.int64), "low": low, "high": high, "n": n, "shard": np.full(len(low), shard, np.int32)})


NOTES = "trigger long, low long, high long, n long, shard int"
PHRASES = "key long, mark long, shard int, low long, high long, raw binary"


def _second_pass(table: pa.Table) -> pa.Table:
    """A shard's distinct phrases of the triggers it is told, or their distinct windows, each with the ids it stands in."""
    shard, uri = table.column("shard")[0].as_py(), table.column("uri").drop_null()[0].as_py()
    table = table.filter(pc.is_valid(table.column("trigger")))
    told = table.column("trigger").to_numpy().view(np.uint64)
    apart = pc.equal(table.column("apart"), True).to_numpy()
    together, apart = np.sort(told[~apart]), np.sort(told[apart])
    held: dict[tuple[int, int], list] = {}
    out = [pa.table({c: pa.array([], t) for c, t in zip(("key", "mark", "low", "high", "raw"), (*[pa.int64()] * 4, pa.binary()), strict=True)})]

    def put() -> None:
        """The phrases held as a table; one that comes again later is another row of it."""
        pairs = np.array(list(held), np.uint64).reshape(len(held), 2).view(np.int64)
        low, high, raw = zip(*held.values(), strict=True)
        out.append(pa.table({"key": pairs[:, 0], "mark": pairs[:, 1], "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64()), "raw": pa.array(raw, pa.binary())}))
        held.clear()

    for ids, raws in _texts(uri) if len(told) else ():
        text = Text.of(raws)
        found, doc_id = _named(ids, parse(text))
        whole = _member(found.trigger, together)
        first, row = _spread(found.begin, np.where(_member(found.trigger, apart), found.windows, 0))
        key, mark = window_keys(text.hashed, first)
        key, mark = np.r_[found.trigger[whole], key], np.r_[found.mark[whole], mark]
        first, size = np.r_[found.begin[whole], first], np.r_[found.windows[whole] + WINDOW - 1, np.full(len(first), WINDOW)]
        owner = np.r_[doc_id[whole], doc_id[row]]
        order, fresh = _groups(key, mark)
        low, high = _least_and_most(order, fresh, (owner, np.minimum), (owner, np.maximum))
        at = order[fresh]
        for k, m, i, n, a, b in zip(key[at].tolist(), mark[at].tolist(), first[at].tolist(), size[at].tolist(), low.tolist(), high.tolist(), strict=True):
            have = held.get((k, m))
            if have is None:
                held[k, m] = [a, b, text.words(i, n)]
            else:
                have[0], have[1] = min(have[0], a), max(have[1], b)
        if len(held) > HELD:
            put()
    if held:
        put()
    made = pa.concat_tables(out)
    return made.add_column(2, "shard", pa.array(np.full(made.num_rows, shard, np.int32)))


def _same_windows(words: np.ndarray) -> np.ndarray:
    """A number for each run of WINDOW words, equal for equal runs: numbers of runs are doubled, so nothing is hashed."""
    reach, rank = 1, words
    while reach < WINDOW:
        step = min(reach, WINDOW - reach)
        pair = rank[: len(rank) - step] * (rank.max(initial=0) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        reach += step
    return rank


def locate(phrases: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, words) of phrases to runs (phrase, first window, count, least id) of windows that stand in two ids.

    Windows that recur are confirmed on their words. Those that only ever stand next to each other are one passage;
    passages are compiled into an automaton over word numbers, and located by streaming all different phrases through
    it, with a number that is no word between them.
    """
    numbers: dict[bytes, int] = {}
    place: dict[bytes, int] = {}
    of = np.array([place.setdefault(raw, len(place)) for _, _, raw in phrases])
    stream: list[int] = []
    start = [0]
    for raw in place:
        stream += [numbers.setdefault(w, len(numbers) + 1) for w in raw.split(b" ")]
        stream.append(0)
        start.append(len(stream))
    low, high = (np.array([p[k] for p in phrases], np.int64) for k in (0, 1))
    least, most = np.full(len(place), np.iinfo(np.int64).max), np.full(len(place), np.iinfo(np.int64).min)
    np.minimum.at(least, of, low)
    np.maximum.at(most, of, high)
    begin = np.array(start)
    phrase = np.repeat(np.arange(len(place)), np.diff(begin))
    # a window that reaches over a phrase's end holds a 0
    at, row = _spread(begin[:-1], np.diff(begin) - WINDOW)
    same = _same_windows(np.array(stream, np.int64))[at]
    kinds, same, total = np.unique(same, return_inverse=True, return_counts=True)
    least_of, most_of = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), np.iinfo(np.int64).min)
    np.minimum.at(least_of, same, least[row])
    np.maximum.at(most_of, same, most[row])
    # neighbouring windows that only ever stand together are one passage, and so stand in the same documents
    pair, pairs = np.unique(same[:-1] * len(kinds) + same[1:] + np.where(row[1:] == row[:-1], 0, len(kinds) ** 2), return_inverse=True, return_counts=True)[1:]
    together = (row[1:] == row[:-1]) & (pairs[pair] == total[same[:-1]]) & (pairs[pair] == total[same[1:]])
    head = np.flatnonzero(np.r_[True, ~together])
    size = np.diff(np.r_[head, len(same)])
    passage, once = np.unique(same[head], return_index=True)
    confirmed = np.flatnonzero(least_of[passage] < most_of[passage])
    if not len(confirmed):
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    windows = size[once[confirmed]]
    for k, (i, n) in enumerate(zip(at[head[once[confirmed]]].tolist(), windows.tolist(), strict=True)):
        automaton.add_word(tuple(stream[i : i + n + WINDOW - 1]), k)
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(tuple(stream))), np.int64)
    long = windows[hits[:, 1]]
    place_of, owner = hits[:, 0] - WINDOW - long + 2, least_of[passage[confirmed]][hits[:, 1]]
    order = np.argsort(place_of, kind="stable")
    place_of, owner, long = place_of[order], owner[order], long[order]
    inside = phrase[place_of]
    edge = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1]) | (place_of[1:] != (place_of + long)[:-1]) | (owner[1:] != owner[:-1])])
    count = np.add.reduceat(long, edge)
    runs_of = inside[edge]
    # every row of a phrase is told its runs
    bounds = np.searchsorted(runs_of, np.arange(len(place) + 1))
    run, told = _spread(bounds[of], bounds[of + 1] - bounds[of])
    yield from zip(told.tolist(), (place_of[edge] - begin[runs_of])[run].tolist(), count[run].tolist(), owner[edge][run].tolist(), strict=True)


FOUND = "shard int, key long, mark long, first int, count int, low long"


def _compiled(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (key, mark, shard, low, high, raw) to runs of their located windows that have the same least id."""
    columns = list(zip(*((rows[i][2], *rows[i][:2], k, n, low) for i, k, n, low in locate([r[3:] for r in rows])), strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "key", "mark", "first", "count", "low"])


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the automata of a task locate, of rows sorted by key: groups of keys are compiled together up to COMPILED bytes."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "mark", "shard", "low", "high", "raw")), strict=True):
            if size >= COMPILED and row[0] != rows[-1][0]:
                yield _compiled(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[5])
    if rows:
        yield _compiled(rows)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary"


class _Told:
    """What a shard is told about phrases or windows, by their two hashes."""

    def __init__(self, key: np.ndarray, mark: np.ndarray) -> None:
        print_ = self._print(key, mark)
        self.order = np.argsort(print_, kind="stable")
        self.print, self.key, self.mark = print_[self.order], key[self.order], mark[self.order]

    @staticmethod
    def _print(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return key * np.uint64(_BASE) + mark

    def join(self, key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the given hashes, and of what was told, that have both equal."""
        print_ = self._print(key, mark)
        low, high = np.searchsorted(self.print, print_), np.searchsorted(self.print, print_, side="right")
        at, row = _spread(low, high - low)
        same = (self.key[at] == key[row]) & (self.mark[at] == mark[row])
        return row[same], self.order[at[same]]


def _last_pass(texts: bool):
    def run(table: pa.Table) -> pa.Table:
        """A shard's documents without the words that the located windows cover, where a smaller id has them."""
        uris = table.column("uri").drop_null()
        found = table.filter(pc.is_valid(table.column("low")))
        key, mark = (found.column(c).to_numpy().view(np.uint64) for c in ("key", "mark"))
        place, count, low = (found.column(c).to_numpy() for c in ("first", "count", "low"))
        told = _Told(key, mark)
        apart = np.sort(table.filter(pc.is_null(table.column("low"))).column("key").drop_null().to_numpy().view(np.uint64))
        rows: list[tuple] = []
        for ids, raws in _texts(uris[0].as_py()):
            text = Text.of(raws)
            phrases, doc_id = _named(ids, parse(text))
            row, run = told.join(phrases.trigger, phrases.mark)
            begin, part = _spread(phrases.begin[row] + place[run], count[run])
            owner, least = doc_id[row][part], low[run][part]
            # windows that were sent apart stand under their own two hashes
            first, row = _spread(phrases.begin, np.where(_member(phrases.trigger, apart), phrases.windows, 0))
            some, run = told.join(*window_keys(text.hashed, first))
            begin, owner, least = np.r_[begin, first[some]], np.r_[owner, doc_id[row[some]]], np.r_[least, low[run]]
            begin = begin[least < owner]
            edges = np.zeros(len(text.begin), np.int64)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + WINDOW, -1)
            rows += _digests(ids, text, np.cumsum(edges[:-1]) > 0, texts)
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _digests(ids: list, text: Text, gone: np.ndarray, texts: bool) -> Iterator[tuple]:
    """Each document's digest: its kept words with one blank between them."""
    data, size = text.data, np.diff(text.begin)
    if gone.any():
        data = np.frombuffer(data, np.uint8)[np.repeat(~gone, size)].tobytes()
    stops = np.r_[0, np.cumsum(np.where(gone, 0, size))]
    left = np.r_[0, np.cumsum(~gone)]
    for k, doc_id in enumerate(ids):
        i, j = int(text.first[k]), int(text.first[k + 1])
        kept = data[stops[i] : max(stops[i], stops[j] - 1)]
        yield doc_id, j - i, j - i - int(left[j] - left[i]), hashlib.sha256(kept).hexdigest(), kept if texts else None


def remove_repeated_words(docs: DataFrame, in_task: int = IN_TASK, texts: bool = False) -> DataFrame:
    """(doc_id, text) to doc_id, n_words, n_removed, kept_sha256 for every row of docs, and kept_text (UTF-8) if texts.

    Words go that a window of WINDOW words covers which also starts in a document with a smaller doc_id. Null and empty
    texts lose nothing, nor do texts of fewer words than a window; long texts are hashed in stretches. Rows of equal
    doc_id are one document to others and take nothing from each other; rows without id take part in nothing. Other
    columns, whatever their names, are neither read nor returned. An empty table gives no rows. Phrases of a shard are
    told apart by 128 bits of hashes; windows are compared word by word.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = scratch(spark, "phrases")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw")).write.option("compression", "zstd").parquet(folder)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    shards = keep(listed.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), F.col("path").alias("uri")), "phrases-shards")
    n = max(1, shards.count())
    notes = shards.repartitionByRange(n, "shard").mapInArrow(_first_pass, NOTES)
    by = Window.partitionBy("trigger")
    met = notes.withColumns({"least": F.min("low").over(by), "most": F.max("high").over(by), "all": F.sum("n").over(by)}).filter("least < most")
    told = keep(met.select("shard", "trigger", (F.col("all") > in_task).alias("apart")), "phrases-told")
    phrases = keep(told.unionByName(shards, allowMissingColumns=True).repartition(2 * n, "shard").groupBy("shard").applyInArrow(_second_pass, PHRASES), "phrases-cut")
    found = phrases.repartition("key").sortWithinPartitions("key").mapInArrow(_located, FOUND)
    apart = told.filter("apart").select("shard", F.col("trigger").alias("key"))
    news = found.unionByName(apart.unionByName(shards, allowMissingColumns=True), allowMissingColumns=True)
    out = news.repartition(2 * n, "shard").groupBy("shard").applyInArrow(_last_pass(texts), RESULT)
    return out if texts else out.drop("kept_text")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
f AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM g JOIN f USING (s) WHERE low < doc_id),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
