"""Removal of repeated passages by prefix-free parsing.

Every string of WINDOW bytes has one trigger: the least rolling hash among its GRAM-byte substrings. Neighbouring
windows with the same trigger (its leftmost place, if it stands twice) form a phrase, which reaches over all bytes of
its windows; so each window lies in exactly one phrase, phrases overlap by WINDOW - 1 bytes, equal windows lie in
phrases of equal trigger, and never two in the same phrase. The parse of a document is its sequence of phrases; the
dictionary holds the distinct ones.

A phrase that the parse has twice is repeated in all its windows. Otherwise a window can only be repeated in another
dictionary phrase of the same trigger. There the dictionary's suffixes are sorted to depth WINDOW by prefix doubling:
neighbours in that suffix array with a common prefix of WINDOW bytes are repeated windows. As phrases overlap by
WINDOW - 1 bytes, corpus order to depth WINDOW is the order of dictionary suffixes, each as often as the parse has its
phrase; the parse is sorted by phrase for that, and nothing behind a phrase can change what is removed. Texts stay in
shards, one file each; only triggers, fingerprints of phrases and the bytes of the dictionary are shuffled, pre-aggregated
per shard, so a passage of any number of copies is one row per shard. A trigger with very many different phrases, as a
common line in many contexts makes, isn't brought together: its windows are dealt out by fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SHARE, bound_batches, keep, release, salted_join, scratch

#: Bytes of a removed string, and of the substrings whose hashes are triggers.
WINDOW, GRAM = 200, 64
#: Bytes hashed together; a longer text is cut into overlapping stretches.
STRETCH = 1 << 20
#: Dictionary phrases of a trigger that are always ranked in one task; beyond, if they are few for a shuffle partition.
IN_TASK = 1000
#: Bytes of a suffix that are compared at first.
WORD = 8

_RANDOM = np.random.Generator(np.random.PCG64(6))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _stir(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32)) ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Rolling hashes of a byte string, from prefix sums of bytes times powers modulo 2**64."""

    power = inverse = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(data) >= len(Hasher.power):
            Hasher.power, Hasher.inverse = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.power[: len(data)], out=self.sums[1:])

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.inverse[begin]

    def every(self, size: int) -> np.ndarray:
        """Of all substrings of a size."""
        return (self.sums[size:] - self.sums[: len(self.sums) - size]) * self.inverse[: len(self.sums) - size]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of width values."""
    n, reach = len(x) - width + 1, 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:n], x[width - reach : width - reach + n])


@dataclass
class Parse:
    """Phrases of many texts: trigger, fingerprint, text, first window, number of windows."""

    trigger: np.ndarray
    mark: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    windows: np.ndarray


def _stretches(texts: list[bytes], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of whole short texts together, or of a long one's stretch; where its texts end; their numbers; their offsets."""
    data, ends, names, size = [], [], [], 0
    for k, raw in enumerate(texts):
        if len(raw) < WINDOW:
            continue
        if size and size + len(raw) > STRETCH:
            yield np.frombuffer(b"".join(data), np.uint8), np.array(ends), np.array(names), np.zeros(len(names), np.int64)
            data, ends, names, size = [], [], [], 0
        if len(raw) > STRETCH:
            for at in range(0, len(raw) - WINDOW + 1, STRETCH - WINDOW + 1):
                part = np.frombuffer(raw, np.uint8)[at : at + STRETCH]
                yield part, np.array([len(part)]), np.array([first + k]), np.array([at])
            continue
        data.append(raw)
        size += len(raw)
        ends.append(size)
        names.append(first + k)
    if size:
        yield np.frombuffer(b"".join(data), np.uint8), np.array(ends), np.array(names), np.zeros(len(names), np.int64)


def parse(texts: list[bytes], first: int = 0) -> Parse:
    """Phrases of texts, which are numbered from first."""
    out: list[tuple] = []
    for data, ends, names, offsets in _stretches(texts, first):
        hashed = Hasher(data)
        grams = _stir(hashed.every(GRAM), 1)
        trigger = _least(grams, WINDOW - GRAM + 1)
        n = len(trigger)
        starts = np.r_[0, ends[:-1]]
        valid = np.ones(n, bool)
        for e in ends[:-1].tolist():
            valid[max(0, e - WINDOW + 1) : e] = False
        # a window that begins at its trigger is the last one with it, whether or not the next trigger is equal
        fresh = np.r_[True, (trigger[1:] != trigger[:-1]) | (grams[: n - 1] == trigger[:-1])]
        fresh[np.minimum(starts, n - 1)] = True
        begin = np.flatnonzero(fresh & valid)
        # a phrase ends before the next one begins, or with its text's last window
        owner = np.searchsorted(ends, begin, side="right")
        stop = np.minimum(np.r_[begin[1:], n], ends[owner] - WINDOW + 1)
        mark = _stir(hashed.at(begin, stop + WINDOW - 1) + (stop - begin).astype(np.uint64), 2)
        out.append((trigger[begin], mark, names[owner], begin - starts[owner] + offsets[owner], stop - begin))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    return Parse(columns[0], columns[1], *(c.astype(np.int64) for c in columns[2:]))


# ---- shards


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _texts(uri: str, rows: int = 500) -> Iterator[tuple[int, list, list[bytes]]]:
    """Number of the first row, ids and UTF-8 bytes of a shard's texts, some at a time."""
    system, path = _system(uri)
    first = 0
    with system.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(rows):
            yield first, batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
            first += batch.num_rows


def _notes(folder: str, shard: int) -> str:
    return f"{folder}/notes/{shard:08d}.arrow"


def _save(folder: str, shard: int, uri: str, found: Parse, attempt: str) -> None:
    """A shard's phrases beside it, under their name only when complete."""
    system, path = _system(_notes(folder, shard))
    system.create_dir(path.rpartition("/")[0], recursive=True)
    table = pa.table({"trigger": found.trigger.view(np.int64), "mark": found.mark.view(np.int64), "text": found.text.astype(np.int32), "begin": found.begin, "windows": found.windows.astype(np.int32)}).replace_schema_metadata({"uri": uri})
    with system.open_output_stream(f"{path}.{attempt}") as f:
        pq.write_table(table, f, compression="zstd", use_dictionary=["text"])
    system.move(f"{path}.{attempt}", path)


def _load(folder: str, shard: int) -> tuple[str, Parse]:
    system, path = _system(_notes(folder, shard))
    with system.open_input_file(path) as f:
        table = pq.read_table(f)
    columns = [table.column(k).to_numpy() for k in range(5)]
    return table.schema.metadata[b"uri"].decode(), Parse(columns[0].view(np.uint64), columns[1].view(np.uint64), *(c.astype(np.int64) for c in columns[2:]))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, and where in that order a new combination begins."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, fresh


def _shared(*keys: np.ndarray) -> np.ndarray:
    """For each row whether another has the same keys."""
    order, fresh = _groups(*keys)
    out = np.zeros(len(order), bool)
    number = np.cumsum(fresh) - 1
    out[order] = np.bincount(number)[number] > 1 if len(order) else out
    return out


def _mixed(found: Parse) -> np.ndarray:
    """For each phrase whether its shard has another phrase of the same trigger that differs."""
    order, fresh = _groups(found.trigger, found.mark)
    t = found.trigger[order[fresh]]
    return np.isin(found.trigger, np.unique(t[1:][t[1:] == t[:-1]]))


def _first_pass(folder: str):
    """Parse shards, save their phrases, and tell each shard's triggers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            for shard, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [parse(texts, first) for first, _, texts in _texts(uri)] or [parse([])]
                found = Parse(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("trigger", "mark", "text", "begin", "windows")))
                _save(folder, shard, uri, found, attempt)
                several = _mixed(found)
                order, fresh = _groups(found.trigger)
                at = order[fresh]
                yield pa.record_batch({"trigger": found.trigger[at].view(np.int64), "mark": found.mark[at].view(np.int64), "several": several[at], "shard": np.full(len(at), shard, np.int32)})

    return run


def _pick(table: pa.Table, kind: str) -> list[np.ndarray]:
    """Trigger, mark, first window and count of the rows of a kind."""
    part = table.filter(pc.equal(table.column("kind"), kind))
    out = [part.column(c).to_numpy() for c in ("trigger", "mark", "first", "count")]
    return [out[0].view(np.uint64), out[1].view(np.uint64), *out[2:]]


PHRASES = "trigger long, mark long, shard int, windows int, raw binary"


def _second_pass(folder: str):
    """A shard's distinct phrases of the triggers it is told, with their bytes: its part of the dictionary."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        uri, found = _load(folder, shard)
        order, fresh = _groups(found.trigger, found.mark)
        at = order[fresh]
        at = at[np.isin(found.trigger[at], _pick(table, "mixed")[0])]
        at = at[np.argsort(found.text[at], kind="stable")]
        text, raw = found.text[at], []
        for first, _, texts in _texts(uri) if len(at) else ():
            for k in range(*np.searchsorted(text, (first, first + len(texts))).tolist()):
                begin = int(found.begin[at[k]])
                raw.append(texts[text[k] - first][begin : begin + int(found.windows[at[k]]) + WINDOW - 1])
        return pa.table({"trigger": found.trigger[at].view(np.int64), "mark": found.mark[at].view(np.int64), "shard": np.full(len(at), shard, np.int32), "windows": found.windows[at].astype(np.int32), "raw": pa.array(raw, pa.binary())})

    return run


def _places(raw: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases' bytes, and of their windows: phrase, place in it, place in the bytes."""
    phrase = np.repeat(np.arange(len(raw)), windows)
    place = np.arange(len(phrase)) - np.repeat(np.cumsum(windows) - windows, windows)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), np.uint8), phrase, place, (np.cumsum(size) - size)[phrase] + place


def _ranks(key: np.ndarray) -> np.ndarray:
    """Ranks of keys from 0 on, equal for equal keys."""
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]] if len(key) else key, dtype=np.uint64)
    return out


def suffix_ranks(data: np.ndarray, begin: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Ranks of the suffixes of data that begin at the given places, by their first depth bytes, which data must have.

    The suffix array to that depth is the order of these ranks. Ranks by WORD bytes are doubled until they reach it; the
    last step overlaps. Suffixes elsewhere are ranked only as what others need.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    reach = min(WORD, depth)
    key = np.zeros(len(data) - reach + 1, np.uint64)
    for k in range(reach):
        key = (key << np.uint64(8)) | data[k : k + len(key)]
    while reach < depth:
        step = min(reach, depth - reach)
        rank = _ranks(key)
        key = rank[: len(rank) - step] * (rank.max() + np.uint64(1)) + rank[step:]
        reach += step
    return _ranks(key[begin])


def _again(rank: np.ndarray) -> np.ndarray:
    """For each suffix whether a neighbour in the suffix array has its rank, so its first bytes."""
    order = np.argsort(rank, kind="stable")
    same = rank[order][1:] == rank[order][:-1]
    out = np.zeros(len(rank), bool)
    out[order] = np.r_[same, False] | np.r_[False, same] if len(rank) else out
    return out


def _runs(phrase: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring places in a phrase: phrase, first place, count."""
    if not len(phrase):
        return phrase, place, place
    at = np.flatnonzero(np.r_[True, (phrase[1:] != phrase[:-1]) | (place[1:] != place[:-1] + 1)])
    return phrase[at], place[at], np.diff(np.r_[at, len(phrase)])


def _rank(table: pa.Table) -> pa.RecordBatch:
    """Repeated windows of whole trigger groups: for each row, the runs of its windows that stand elsewhere too."""
    trigger, mark, windows = (table.column(c).to_numpy() for c in ("trigger", "mark", "windows"))
    order, fresh = _groups(trigger, mark)
    several = _shared(trigger, mark)
    at = order[fresh]
    data, phrase, place, begin = _places([table.column("raw")[k].as_py() for k in at.tolist()], windows[at].astype(np.int64))
    again = _again(suffix_ranks(data, begin)) | several[at][phrase]
    phrase, first, count = _runs(phrase[again], place[again])
    # every shard that has the phrase is told
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    by = np.argsort(number, kind="stable")
    low, high = np.searchsorted(number[by], phrase), np.searchsorted(number[by], phrase, side="right")
    row = by[np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
    first, count = np.repeat(first, high - low), np.repeat(count, high - low)
    shard = table.column("shard").to_numpy()
    return pa.record_batch({"shard": shard[row], "trigger": trigger[row], "mark": mark[row], "first": first.astype(np.int32), "count": count.astype(np.int32)})


RUNS = "shard int, trigger long, mark long, first int, count int"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank the dictionary's windows, trigger group by trigger group, of rows that are sorted by trigger."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.get_total_buffer_size()
        if size < 4 * STRETCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        trigger = table.column("trigger").to_numpy()
        whole = int(np.searchsorted(trigger, trigger[-1]))
        if whole:
            yield _rank(table.slice(0, whole).combine_chunks())
            held = table.slice(whole).combine_chunks().to_batches()
        size = sum(b.get_total_buffer_size() for b in held)
    if held:
        yield _rank(pa.Table.from_batches(held).combine_chunks())


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of phrases as a row."""
    for batch in batches:
        trigger, mark, shard, windows = (batch.column(k).to_numpy() for k in range(4))
        data, phrase, place, begin = _places(batch.column(4).to_pylist(), windows.astype(np.int64))
        prints = _stir(Hasher(data).at(begin, begin + WINDOW), 3)
        yield pa.record_batch({"trigger": trigger[phrase], "mark": mark[phrase], "shard": shard[phrase], "first": place.astype(np.int32), "print": prints.view(np.int64)})


def repeated_windows(phrases: DataFrame, in_task: int) -> DataFrame:
    """Runs of windows of the dictionary's phrases that stand in two places or more, per shard and phrase.

    Groups of a trigger are ranked where they meet, unless they hold more than in_task phrases and more than 1 / SHARE
    of an average shuffle partition: those triggers are fewer than SHARE times the partitions, so they are collected and
    sent out; their phrases are not shuffled, only fingerprints of their windows are. The order of rows doesn't matter.
    """
    spark = phrases.sparkSession
    limit = max(in_task, phrases.count() // (SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = phrases.groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("trigger").collect()
    few = F.broadcast(spark.createDataFrame(hot, "trigger long"))
    rest = phrases.join(few, "trigger", "left_anti") if hot else phrases
    small = rest.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_ranked, RUNS)
    if not hot:
        return small
    rows = phrases.join(few, "trigger", "left_semi").select(*phrases.columns).mapInArrow(_exploded, "trigger long, mark long, shard int, first int, print long")
    rows = keep(rows, "repeats-windows")
    # a phrase of several shards has its windows once from each, so a count of 2 is a repeat either way
    counted = keep(rows.groupBy("trigger", "print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeats-counted")
    several = salted_join(rows, counted, ["trigger", "print"], held="n").select("shard", "trigger", "mark", "first", F.lit(1).alias("count"))
    return small.unionByName(several)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _last_pass(folder: str):
    """Digests of a shard's texts, from its phrases and the runs of repeated windows it is told."""

    def run(table: pa.Table) -> pa.Table:
        uri, found = _load(folder, table.column("shard")[0].as_py())
        whole = _shared(found.trigger, found.mark) | np.isin(found.trigger, _pick(table, "whole")[0])
        trigger, mark, first, count = _pick(table, "run")
        phrase, told = _match(found.trigger, found.mark, trigger, mark)
        text = np.r_[found.text[whole], found.text[phrase]]
        begin = np.r_[found.begin[whole], found.begin[phrase] + first[told]]
        end = np.r_[found.begin[whole] + found.windows[whole], found.begin[phrase] + first[told] + count[told]] + WINDOW - 1
        order = np.argsort(text, kind="stable")
        text, begin, end = text[order], begin[order], end[order]
        rows: list[tuple] = []
        for start, ids, texts in _texts(uri):
            for k, (doc_id, raw) in enumerate(zip(ids, texts, strict=True), start):
                a, b = np.searchsorted(text, (k, k + 1))
                rows.append((doc_id, *_digest(raw, begin[a:b], end[a:b])))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _match(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (a, b), which hold a pair once where it matters, beside the rows of (of_a, of_b) with the same pair."""
    order, fresh = _groups(np.r_[a, of_a], np.r_[b, of_b])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    place = np.full(len(order), -1)
    place[number[: len(a)]] = np.arange(len(a))
    at = place[number[len(a) :]]
    told = np.flatnonzero(at >= 0)
    return at[told], told


def _digest(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str]:
    if not len(begin):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    edges = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, end, -1)
    gone = np.cumsum(edges[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), int(np.count_nonzero(gone)), spans, hashlib.sha256(left).hexdigest()


def remove_repeats(docs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Bytes go that a string of WINDOW bytes covers which also starts anywhere else in docs, in the same text included;
    strings don't reach over a text's end. Null and empty texts lose nothing; long ones are parsed in overlapping
    stretches. Rows of equal doc_id are texts of their own, and equal rows repeat each other. Other columns, whatever
    their names, are neither read nor returned. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = scratch(spark, "repeats")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw")).write.option("compression", "zstd").parquet(f"{folder}/shards")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards")
    shards = keep(listed.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), F.col("path").alias("uri")), "repeats-shards")
    n = max(1, shards.count())
    # texts are what takes time here, so shards are dealt out by number whatever the size of the rows about them
    places = shards.repartitionByRange(n, "shard")
    notes = places.mapInArrow(_first_pass(folder), "trigger long, mark long, several boolean, shard int")
    by = Window.partitionBy("trigger")
    met = notes.withColumns({"n": F.count(F.lit(1)).over(by), "low": F.min("mark").over(by), "high": F.max("mark").over(by), "any": F.max("several").over(by)}).filter("n > 1 or any")
    kind = F.when((F.col("low") == F.col("high")) & ~F.col("any"), F.lit("whole")).otherwise(F.lit("mixed"))
    none = F.lit(0)
    told = keep(met.select("shard", kind.alias("kind"), "trigger", none.cast("long").alias("mark"), none.alias("first"), none.alias("count")), "repeats-told")
    phrases = keep(told.repartition(2 * n, "shard").groupBy("shard").applyInArrow(_second_pass(folder), PHRASES), "repeats-phrases")
    runs = repeated_windows(phrases, in_task).select("shard", F.lit("run").alias("kind"), "trigger", "mark", "first", "count")
    every = shards.select("shard", F.lit("shard").alias("kind"), *[none.cast("long").alias(c) for c in ("trigger", "mark")], *[none.alias(c) for c in ("first", "count")])
    news = told.filter("kind = 'whole'").unionByName(runs).unionByName(every)
    return news.repartition(2 * n, "shard").groupBy("shard").applyInArrow(_last_pass(folder), RESULT)
