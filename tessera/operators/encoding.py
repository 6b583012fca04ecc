"""Conversations to token ids and labels for training, by a tokenizer file, with proofs of the mask.

The rendered form of a turn is a start token, its role, a line break, its text, an end token and a line break. Role and
text between those tokens are encoded apart from everything else, as a tokenizer does around special tokens, so control
strings that stand in a text are ordinary text. What a turn adds to the tokens of the turns before it is then known
from the offsets of its own tokens, and each text is encoded once, however many turns follow.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import bound_batches

#: Label of a token that carries no loss. Fixed value.
IGNORE = -100
#: How an observation begins that rejects the turn before it. Fixed value.
REJECTED = "error:"
#: Bytes of texts and conversations that are encoded at one time (a longer conversation is alone), turns that are
#: remembered, and characters of those at most.
AT_ONCE, CONVERSATIONS, KNOWN, SHORT = 256 << 10, 200, 20_000, 200
ENCODED, NOTHING, LONG, VIOLATION = "encoded", "nothing_graded", "too_long", "masking_violation"


class Encoder:
    """A byte-level tokenizer with two more ids, for the start and the end of a turn."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        described = json.loads(self.library.to_str())
        if (described["pre_tokenizer"] or {}).get("type") != "ByteLevel" or described["normalizer"]:
            raise ValueError("the tokenizer must be byte-level, without normalizer, so that its tokens cover the text")
        self.start, self.end = self.library.get_vocab_size(), self.library.get_vocab_size() + 1
        #: Bytes of the longest token.
        self.longest = max(map(len, self.library.get_vocab()))
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.known: dict[tuple[str, str], tuple[list[int], int, bool]] = {}

    def turns(self, pieces: list[tuple[str, str]]) -> list[tuple[list[int], int, bool]]:
        """For each (role, text): its tokens, the place of the first one that isn't its header's alone, and whether
        that one begins in the header. Turns that come again soon and are short are encoded once."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list(dict.fromkeys(p for p in pieces if p not in self.known))
        fresh = {}
        for piece, made in zip(new, self.library.encode_batch([f"{role}\n{text}" for role, text in new], add_special_tokens=False), strict=True):
            head, ids = len(piece[0]) + 1, made.ids
            first = next((i for i in range(len(ids)) if made.token_to_chars(i)[1] > head), len(ids))
            straddles = first < len(ids) and made.token_to_chars(first)[0] < head
            fresh[piece] = ([self.start, *ids, self.end, *self.line], first + 1, straddles)
        self.known.update((piece, of) for piece, of in fresh.items() if len(piece[0]) + len(piece[1]) <= SHORT)
        return [fresh.get(p) or self.known[p] for p in pieces]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode([i for i in ids if i < self.start], skip_special_tokens=True)


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs; what it remembers stays bounded by KNOWN and SHORT."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def runs(labels: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of labels that carry loss: begin, end (exclusive)."""
    edge = np.flatnonzero(np.diff(np.r_[False, labels != IGNORE, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def violations(encoder: Encoder, ids, labels: np.ndarray, said: list[str]) -> list[str]:
    """What is wrong with a mask, judged by the tokens it grades and by the assistant's texts."""
    flat = lambda t: " ".join(t.split())
    found, graded, said = [], runs(labels), [flat(t) for t in said]
    if not graded:
        return ["nothing_graded"]
    if len(graded) > len(said):
        found.append("more_runs_than_turns")
    if graded[0][0] == 0:
        found.append("graded_from_start")
    texts = [flat(encoder.decode(ids[a:b])) for a, b in graded]
    if any(t and not any(t in s for s in said) for t in texts):
        found.append("not_model_output")
    return found


def _example(encoder: Encoder, turns: list[dict], made: list[tuple[list[int], int, bool]], max_len: int) -> dict:
    labels: list[np.ndarray] = []
    mismatched = spans = 0
    for turn, (own, first, straddles) in zip(turns, made, strict=True):
        label = np.full(len(own), IGNORE, np.int32)
        if turn["graded"]:
            label[first:] = own[first:]
            spans += 1
            mismatched += straddles
        labels.append(label)
    if sum(map(len, labels)) > max_len:
        return {"outcome": LONG}
    ids, label = np.fromiter(chain.from_iterable(own for own, _, _ in made), np.int32), np.concatenate(labels)
    found = violations(encoder, ids, label, [t["text"] for t in turns if t["role"] == "assistant"])
    return {
        "outcome": VIOLATION if found else ENCODED, "input_ids": ids, "labels": label, "n_tokens": len(ids), "n_graded": int((label != IGNORE).sum()),
        "n_spans": spans, "n_mismatched": mismatched, "findings": found,
    }


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of conversations of AT_ONCE bytes and CONVERSATIONS at most; a longer one is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > AT_ONCE or i - start == CONVERSATIONS):
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def _lists(values: list[np.ndarray | None]) -> pa.ListArray:
    """Arrays as an Arrow column of lists, without a Python object a number."""
    ends = np.cumsum([0] + [0 if v is None else len(v) for v in values], dtype=np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *[v for v in values if v is not None]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=pa.array([v is None for v in values], pa.bool_()))


MADE = "outcome string, input_ids array<int>, labels array<int>, n_tokens int, n_graded int, n_spans int, n_mismatched int, findings array<string>"


def _graded_turns(turns: DataFrame, grade_rejected: bool) -> DataFrame:
    """Turns with place, graded, and of their conversation: the last graded place, rejected turns, bytes up to that place."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "role"))
    skip = F.coalesce(F.col("skip_final"), F.lit(False)) if "skip_final" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", "turn", role, text, skip.alias("skip"))
    order, whole = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"), Window.partitionBy("conv_id")
    own = F.col("role") == "assistant"
    rows = rows.withColumns({"place": F.row_number().over(order), "said": F.coalesce((F.lead("role").over(order) == "user") & F.lead("text").over(order).startswith(REJECTED), F.lit(False)) & own})
    rows = rows.withColumn("final", F.max(F.when(own, F.col("place"))).over(whole))
    rows = rows.withColumn("graded", own & (F.lit(grade_rejected) | ~F.col("said")) & ~(F.col("skip") & (F.col("place") == F.col("final"))))
    rows = rows.withColumns({"last": F.max(F.when(F.col("graded"), F.col("place"))).over(whole), "n_rejected": F.count_if(F.col("said")).over(whole).cast("int") if not grade_rejected else F.lit(0)})
    kept = F.coalesce(F.col("place") <= F.col("last"), F.lit(False))
    return rows.withColumns({"kept": kept, "n_bytes": F.coalesce(F.sum(F.when(kept, F.octet_length("text"))).over(whole), F.lit(0))})


def encode(turns: DataFrame, tokenizer: str, max_len: int = 3072, grade_rejected: bool = False) -> DataFrame:
    """(conv_id, turn, role, text) to a row per conversation with token ids, and labels that are IGNORE where no loss is.

    Graded are the assistant's texts with the end of their turn, but not those that the next user turn rejects (unless
    grade_rejected), nor a conversation's last one where the column skip_final, if there is one, is true. What follows
    the last graded turn is left out. outcome is encoded, nothing_graded, too_long (more than max_len tokens; never cut)
    or masking_violation, with findings; only the first and the last have ids and counts. n_mismatched counts graded
    turns whose first token begins in their header. Columns: conv_id, n_rejected, and those of MADE.

    Turns are ordered by (turn, role, text), null turn numbers last. Null roles and texts are empty; rows without conv_id
    are one conversation; an empty table gives no rows; other columns are not read. A conversation whose bytes can't fit
    into max_len tokens is known to be too long before its texts are brought together, and conversations are encoded a few
    at a time, so memory is bounded by max_len and AT_ONCE whatever the table's size.
    """
    bound_batches(turns.sparkSession)
    most = max_len * Encoder(tokenizer).longest
    rows = _graded_turns(turns, grade_rejected)
    here = F.when(F.col("kept") & (F.col("n_bytes") <= most), F.struct("place", "role", "text", "graded"))
    of = rows.groupBy("conv_id").agg(F.max("n_rejected").alias("n_rejected"), F.max("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(here)).alias("turns"))
    made = T._parse_datatype_string(MADE)
    schema = T.StructType([of.schema["conv_id"], of.schema["n_rejected"], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        encoder = worker_encoder(tokenizer)
        for whole in batches:
            # those that are known to be too long hold no turns here
            for low, high in _slices([0 if n > most else n for n in whole.column("n_bytes").to_pylist()]):
                batch, out = whole.slice(low, high - low), []
                size, conversations = batch.column("n_bytes").to_pylist(), batch.column("turns").to_pylist()
                encoded = iter(encoder.turns([(t["role"], t["text"]) for c in conversations for t in c]))
                for n, conversation in zip(size, conversations, strict=True):
                    if n > most:
                        out.append({"outcome": LONG})
                    elif not conversation:
                        out.append({"outcome": NOTHING})
                    else:
                        out.append(_example(encoder, conversation, [next(encoded) for _ in conversation], max_len))
                columns = [_lists([r.get(f.name) for r in out]) if f.name in ("input_ids", "labels") else pa.array([r.get(f.name) for r in out], to_arrow_type(f.dataType)) for f in made.fields]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("n_rejected"), *columns], names=schema.names)

    return of.mapInArrow(run, schema)


def outcomes(examples: DataFrame) -> DataFrame:
    """Rows of encode to the number of conversations of each outcome, and the sums and means of those encoded."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return examples.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_graded").alias("n_graded"), mean("n_tokens", "mean_tokens"), F.max("n_tokens").alias("most_tokens"),
        mean(F.col("n_graded") / F.col("n_tokens"), "mean_graded_fraction"), mean("n_spans", "mean_spans"), F.sum("n_mismatched").alias("n_mismatched"), F.sum("n_rejected").alias("n_rejected"),
    )
