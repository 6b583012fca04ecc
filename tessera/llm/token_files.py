"""Token ids as Arrow files of fixed-size lists.

Documents are range-partitioned by id and sorted; each partition packs its ids into rows of SEQUENCE ids, written as
record batches to one file in Arrow's file format. Column ids is a fixed-size list in the smallest unsigned type that
holds the vocabulary. Column mask is a fixed-size list of one byte a place, 1 where there is an id and 0 for padding; it
is dictionary-encoded, as all sequences but a part's last have the same mask, so a part holds at most two of them. Ids
and mask of any sequence are views of the memory-mapped file: nothing is copied or unpacked. A second file beside it
holds the documents' ids and their numbers of tokens in the same order.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, forget, pieces, scratch

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 2048, 64
END_ID = 2
#: Distinct words whose ids a worker remembers before it forgets those asked for once, and the length above which one
#: isn't remembered. With these a worker's memory doesn't grow with the table.
CACHE, LONGEST = 200_000, 64
#: Bytes of texts, and characters of a long one, that are cut to words at a time.
SLICE = 2 << 20
#: Words that are given to the library as one text, and texts given to it at a time: its results are large.
JOINED, LOT = 64, 512
MANIFEST = "part int, tokens string, documents string, n_docs long, n_tokens long"

#: Cut of a lower-cased text, and the normalizer, pre-tokenizer and model settings of a vocabulary file that cuts and
#: lower-cases texts like that. Fixed values, the tokenizer file's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
WORD_END = "</w>"
#: Kinds of characters: what PATTERN tells apart, and those that are not cut here.
BLANK, LETTER, NUMBER, SYMBOL, ODD = range(5)


def schemas(sequence: int, wide: bool) -> tuple[pa.Schema, pa.Schema]:
    mask = pa.dictionary(pa.int8(), pa.list_(pa.uint8(), sequence))
    tokens = pa.schema([pa.field("ids", pa.list_(pa.uint32() if wide else pa.uint16(), sequence), False), pa.field("mask", mask, False)])
    return tokens, pa.schema([pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64(), False)])


class Memory:
    """Ids of strings, bounded: beyond CACHE all go that were not asked for again, and the older half of a CACHE of the others."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.again: set[str] = set()

    def missing(self, wanted: set[str]) -> set[str]:
        if len(self.ids) > CACHE:
            self.ids = {x: self.ids[x] for x in self.ids if x in self.again}
            self.again = set()
            forget(self.ids, CACHE // 2)
        new = wanted.difference(self.ids)
        self.again |= wanted - new
        return new

    def drop_long(self, new: Iterable[str]) -> None:
        for x in new:
            if len(x) > LONGEST:
                del self.ids[x]


class Encoder:
    """Ids of texts as little-endian bytes of 2 or 4 each, by the tokenizers library.

    Where a file's settings are NORMALIZER and CUTTER, texts of printable Latin characters in composed form are
    lower-cased and cut to words here, many at a time; Arrow numbers the distinct words, new ones go to the library's
    model many at a time, and their ids are remembered. There are far fewer words than blank-separated pieces, which
    differ in case and punctuation too. Pieces with other characters take the library's whole way and are remembered as
    they are, as nothing joins what a blank separates. With any other file whole texts take it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same model, not one more; added tokens are left out, as words come from pieces that hold none
        self.words_only = Tokenizer(self.tokenizer.model)
        self.words_only.normalizer, self.words_only.pre_tokenizer = Sequence([]), WhitespaceSplit()
        for t in (self.tokenizer, self.words_only):
            t.no_truncation()
            t.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.wide = size > 1 << 16
        self.kind = np.dtype(np.uint32 if self.wide else np.uint16)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.by_word = (held["normalizer"], held["pre_tokenizer"], model["type"], model.get("end_of_word_suffix")) == (NORMALIZER, CUTTER, "BPE", WORD_END)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        # the characters that are cut here are composed, and their lower case is among them, of the same kind and length
        printable = [c for c in map(chr, range(33, 0x250)) if c.isprintable()]
        plain = [c for c in printable if c.lower() in printable and len(c.lower().encode()) == len(c.encode())]
        self.odd = re.compile(rf"[^\n {''.join(map(re.escape, plain))}]|<\|").search
        self.kinds = np.full(0x800, ODD, np.uint8)
        self.kinds[[10, 32]] = BLANK
        self.kinds[[ord(c) for c in plain]] = [{"L": LETTER, "N": NUMBER}.get(category(c)[0], SYMBOL) for c in plain]
        # by byte: those that begin longer characters are odd
        self.bytes = np.concatenate([self.kinds[:128], np.full(128, BLANK, np.uint8)])
        self.bytes[224:] = ODD
        self.known = Memory()
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in set(visible))
        self.letters = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}

    def _bytes(self, ids: list[int]) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()

    def _ids(self, texts: list[str], words_only: bool = False) -> Iterator[list[int]]:
        """Ids of each text; the library's results, which are far larger, are there for LOT texts at a time."""
        tokenizer = self.words_only if words_only else self.tokenizer
        for i in range(0, len(texts), LOT):
            yield from (e.ids for e in tokenizer.encode_batch_fast(texts[i : i + LOT], add_special_tokens=False))

    def _spell(self, words: list[str]) -> None:
        """Remember the ids of new words: JOINED of them are one text to the library, whose words end where ids say so."""
        plain = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        texts = [" ".join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
        ids = np.fromiter(chain.from_iterable(self._ids(texts, True)), np.int64)
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
        if len(stops) != len(words):
            raise ValueError("the vocabulary has no word ends")
        raw, begin = ids.astype(self.kind).tobytes(), 0
        for w, stop in zip(words, stops, strict=True):
            self.known.ids[w] = raw[begin:stop]
            begin = stop

    def _learn(self, new: set[str]) -> None:
        rest = list(filter(self.odd, new))
        self._spell(list(new.difference(rest)))
        for got, piece in zip(self._ids(rest), rest, strict=True):
            self.known.ids[piece] = self._bytes(got)

    def _kinds(self, raw: np.ndarray) -> np.ndarray:
        """The kind of the character that each byte is of."""
        kinds = self.bytes[raw]
        two = np.flatnonzero((raw >= 192) & (raw < 224))
        kinds[two] = kinds[two + 1] = self.kinds[(raw[two] & 31).astype(np.int16) << 6 | raw[two + 1] & 63]
        return kinds

    def _hide(self, texts: list[str]) -> tuple[list[str], list[str], list[int]]:
        """texts with an odd character in place of each piece that has one, those distinct pieces, and their numbers in order."""
        split = {i: t.split(" ") for i, t in enumerate(texts) if self.odd(t)}
        odd = {x: n for n, x in enumerate(filter(self.odd, set(chain.from_iterable(split.values()))))}
        order = [odd[x] for x in chain.from_iterable(split.values()) if x in odd]
        return [" ".join(["\0" if x in odd else x for x in split[i]]) if i in split else t for i, t in enumerate(texts)], list(odd), order

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of texts by PATTERN and odd pieces, their numbers in order, and how many stand before each text's end."""
        hidden, order = [], []
        joined = "\n".join([*texts, ""])
        kinds = self._kinds(np.frombuffer(joined.encode(), np.uint8))
        if "<|" in joined or (kinds == ODD).any():
            texts, hidden, order = self._hide(texts)
            joined = "\n".join([*texts, ""])
            kinds = self._kinds(np.frombuffer(joined.encode(), np.uint8))
        raw = np.frombuffer(joined.lower().encode(), np.uint8)
        begins = kinds == NUMBER
        begins[0] = True
        begins[1:] |= kinds[1:] != kinds[:-1]
        begins[(raw & 192) == 128] = False
        # an apostrophe that begins a run of symbols and the letters after it that PATTERN names are a word
        at = np.flatnonzero((raw[:-1] == ord("'")) & begins[:-1] & (kinds[1:] == LETTER))
        first, second = raw[at + 1], raw[at + 2]
        ends = np.where(np.isin(first, list(b"stmd")), 2, 0)
        for a, b in (b"re", b"ve", b"ll"):
            ends[(first == a) & (second == b)] = 3
        at, ends = at[ends > 0], ends[ends > 0]
        begins[at + 1] = False
        begins[at + ends] = True
        held = kinds != BLANK
        begins &= held
        offsets = np.append(np.flatnonzero(begins[held]), held.sum()).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw[held])).dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if hidden:
            at = distinct.index("\0")
            index = index.copy()
            index[index == at] = np.add(order, len(distinct))
            distinct[at] = hidden[0]  # no word has this number any more
            distinct += hidden
        stops = np.cumsum([len(t.encode()) + 1 for t in texts]) - 1
        return distinct, index, np.cumsum(begins)[stops]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if not self.by_word:
            return [self._bytes(x) for x in self._ids(texts)]
        if max(map(len, texts), default=0) > SLICE:
            return [b"".join(self._encode([x])[0] for x in stretches(t, SLICE)) for t in texts]
        return self._encode(texts) if texts else []

    def _encode(self, texts: list[str]) -> list[bytes]:
        distinct, index, stops = self._cut(texts)
        new = self.known.missing(set(distinct))
        self._learn(new)
        ids = pa.array(map(self.known.ids.__getitem__, distinct), pa.binary()).take(pa.array(index))
        self.known.drop_long(new)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[np.append(0, stops)].tolist()
        raw = ids.buffers()[2].to_pybytes() if ends[-1] else b""
        return [raw[a:b] for a, b in pairwise(ends)]


def stretches(text: str, n: int) -> Iterator[str]:
    """text cut at blanks, which go, into stretches of n characters or what more it takes to the next blank."""
    at = 0
    while (cut := text.find(" ", at + n)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs; its caches stay bounded by CACHE."""
    return Encoder(path)


class Packer:
    """Writes documents' ids to the two files of a part; they appear under their names only when complete."""

    def __init__(self, folder: str, part: int, attempt: str, sequence: int, wide: bool) -> None:
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.sequence, self.ids, self.docs = sequence, *schemas(sequence, wide)
        self.kind = np.dtype(np.uint32 if wide else np.uint16)
        self.end = np.asarray([END_ID], self.kind).tobytes()
        self.names = [f"{root}/tokens-{part:06d}.arrow", f"{root}/documents-{part:06d}.arrow"]
        self.temporary = [f"{n}.{attempt}" for n in self.names]
        self.sinks = [self.fs.open_output_stream(n) for n in self.temporary]
        added = pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)
        self.writers = [pa.ipc.new_file(s, x, options=added) for s, x in zip(self.sinks, (self.ids, self.docs), strict=True)]
        self.held: list[bytes] = []
        self.rows: tuple[list, list[int]] = ([], [])
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: list, encoded: list[bytes]) -> None:
        size = self.kind.itemsize
        lengths = [len(x) // size + 1 for x in encoded]
        for x in encoded:
            self.held += (x, self.end)
        self.rows[0].extend(doc_ids)
        self.rows[1].extend(lengths)
        self.n_docs += len(doc_ids)
        self.n_held += sum(lengths)
        if self.n_held >= self.sequence * BATCH:
            self._flush(False)

    def _masks(self, used: int, n: int) -> pa.DictionaryArray:
        """Masks of n sequences whose places are used up to the given one."""
        whole = np.ones(self.sequence, np.uint8)
        kinds, index = [whole], np.zeros(n, np.int8)
        if used < n * self.sequence:
            kinds.append((np.arange(self.sequence) < used % self.sequence).astype(np.uint8))
            index[-1] = 1
        return pa.DictionaryArray.from_arrays(pa.array(index), pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(kinds)), self.sequence))

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        block = self.sequence * BATCH
        whole = len(ids) if last else len(ids) // block * block
        for at in range(0, whole, block):
            x = ids[at : min(at + block, whole)]
            flat = np.pad(x, (0, -len(x) % self.sequence))
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.sequence), self._masks(len(x), len(flat) // self.sequence)]
            self.writers[0].write_batch(pa.record_batch(columns, schema=self.ids))
        self.writers[1].write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in self.rows], schema=self.docs))
        self.n_tokens += whole
        self.held, self.rows, self.n_held = [ids[whole:].tobytes()], ([], []), len(ids) - whole

    def close(self) -> tuple[list[str], int, int]:
        self._flush(True)
        for w, s in zip(self.writers, self.sinks, strict=True):
            w.close()
            s.close()
        for t, n in zip(self.temporary, self.names, strict=True):
            self.fs.move(t, n)
        return self.names, self.n_docs, self.n_tokens


def write_tokens(docs: DataFrame, path: str, folder: str, sequence: int = SEQUENCE) -> DataFrame:
    """Write (doc_id, text) as token files below folder, a URI; the manifest, one row per part in ascending id order.

    Null texts are empty; END_ID ends every document. Null ids come first. Rows of equal id are ordered by a hash of
    their text. A part that is written again, after a lost executor, replaces its files by equal ones.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder, packer = worker_encoder(path), None
        for batch in batches:
            for piece in pieces(batch, 1, SLICE):
                packer = packer or Packer(folder, task.partitionId(), str(task.taskAttemptId()), sequence, encoder.wide)
                packer.add(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()))
        if packer:
            (tokens, documents), n_docs, n_tokens = packer.close()
            scheme = folder.partition("/")[0] + "//" if folder.startswith("file:") else folder[: folder.index("://") + 3]
            yield pa.record_batch({"part": pa.array([task.partitionId()], pa.int32()), "tokens": [scheme + tokens], "documents": [scheme + documents], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return rows.mapInArrow(run, MANIFEST)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Documents of the manifest's files, which has start, the ids before each part: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _digest(row["tokens"], row["documents"], row["start"])

    return manifest.select("tokens", "documents", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_file(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A part's reader; a local file is memory-mapped, so its batches are views of it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))


def read_sequence(uri: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of a part's i-th sequence, without reading the others: views of the file where it is local."""
    batch = open_file(uri).get_batch(i // BATCH)
    ids, mask = batch.column(0)[i % BATCH].values, batch.column(1)
    return ids.to_numpy(), mask.dictionary[mask.indices[i % BATCH].as_py()].values.to_numpy()


def _digest(tokens: str, documents: str, start: int) -> Iterator[pa.RecordBatch]:
    """Rows of a part's documents, by the lengths of one file and the ids of the other, batch by batch."""
    names, reader = open_file(documents), open_file(tokens)
    ids, k = np.zeros(0, "<u4"), 0
    for b in range(names.num_record_batches):
        batch = names.get_batch(b)
        doc_ids, lengths = batch.column(0), batch.column(1).to_pylist()
        crcs = []
        for n in lengths:
            crc = 0
            while n:
                if not len(ids):
                    if k == reader.num_record_batches:
                        raise ValueError(f"{tokens} and {documents} disagree")
                    ids, k = reader.get_batch(k).column(0).flatten().to_numpy().astype("<u4"), k + 1
                part = ids[:n]
                crc, ids, n = zlib.crc32(part, crc), ids[len(part) :], n - len(part)
            crcs.append(crc)
        starts = start + np.cumsum([0, *lengths])
        start = int(starts[-1])
        yield pa.record_batch([doc_ids, pa.array(starts[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def with_starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each part: one row per file, so the totals are summed on the driver."""
    rows, start, out = sorted(manifest.collect(), key=lambda r: r["part"]), 0, []
    for r in rows:
        out.append((*r, start))
        start += r["n_tokens"]
    # as an Arrow table, which the JVM reads: rows would start one more Python worker for each core
    columns = zip(*out, strict=True) if out else [[] for _ in range(6)]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["part", "tokens", "documents", "n_docs", "n_tokens", "start"]
    df = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names))
    return df.repartition(max(1, min(len(out), spark.sparkContext.defaultParallelism * 4)))


def token_digest(docs: DataFrame, path: str, folder: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Write docs' token files, read them back, and return a row per document: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts hold the end id alone. Texts of any length are written piece by piece over batches. Repeated
    rows are documents of their own, in a row; null doc_ids come first. Other columns are not read, whatever their
    names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    return read_documents(with_starts(spark, write_tokens(docs, path, folder or scratch(spark, "tokens"), sequence)))


