"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie one after another in one array of symbol ids. A round finds each pre-token's lowest-rank
adjacent pair, replaces all its occurrences at once, left to right, and drops pre-tokens without a mergeable pair.
What a pre-token's last round leaves is its number of tokens. A merge's result can only take part in later merges,
so replacing all occurrences of the lowest rank together gives what one-at-a-time merging gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import OWN, annotate, forget

#: Distinct pieces and words whose counts a worker remembers before it forgets the older half.
CACHE = 600_000
#: Pieces whose pre-tokens are merged together in one ragged array.
ROUND = 50_000
LIMIT = 1024


class RankMerger:
    """Merge table of a tokenizer file as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.vocab = vocab
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.fromiter((vocab[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((vocab[b] for _, b in pairs), np.int64, len(pairs))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        # a hash table of 2^20 places holds most pairs; those that share a place are searched for
        self.table = np.full(1 << 20, -1, np.int32)
        places = self._place(self.keys)
        self.table[places] = np.arange(len(keys))
        self.shared = np.zeros(1 << 20, bool)
        self.shared[places[self.table[places] != np.arange(len(keys))]] = True
        self.made = np.fromiter((vocab[a + b] for a, b in pairs), np.int64, len(pairs))
        self.none = np.int64(len(pairs))
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, self.none where it doesn't merge."""
        keys = a * self.width + b
        places = self._place(keys)
        at = self.table[places]
        got = np.where((self.keys[at] == keys) & (at >= 0), self.rank[at], self.none)
        late = np.flatnonzero(self.shared[places] & (got == self.none))
        if len(late):
            at = np.minimum(np.searchsorted(self.keys, keys[late]), len(self.keys) - 1)
            got[late] = np.where(self.keys[at] == keys[late], self.rank[at], self.none)
        return got

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token, given in the vocabulary's byte alphabet; empty ones have none."""
        size = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        out = np.zeros(len(pre_tokens), np.int64)
        get = self.vocab.__getitem__
        ids = np.fromiter(map(get, "".join(pre_tokens)), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(pre_tokens)), size)
        while len(ids):
            rank = np.full(len(ids), self.none)
            inner = owner[1:] == owner[:-1]
            rank[:-1][inner] = self.ranks(ids[:-1][inner], ids[1:][inner])
            starts = np.flatnonzero(np.r_[True, ~inner])
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(ids)])
            ended = lowest == self.none
            out[owner[starts[ended]]] = length[ended]
            hit = (rank == np.repeat(lowest, length)) & (rank != self.none)
            # in a run of overlapping hits (a symbol paired with itself) every other one merges, from the left
            at = np.flatnonzero(hit)
            fresh = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) if len(at) else at
            same = ids[at] == ids[np.minimum(at + 1, len(ids) - 1)]
            at = at[~same | (place % 2 == 0)]
            ids[at] = self.made[rank[at]]
            stay = ~np.repeat(ended, length)
            stay[at + 1] = False
            ids, owner = ids[stay], owner[stay]
        return out


class TokenCounter:
    """Token counts of texts with a tokenizer file's own pre-tokenizer and the merger above."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.merger = RankMerger(path)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.runs = re.compile(r"\s | \s|^ | $").search

    def _learn(self, pieces: list[str]) -> None:
        """Remember each piece's count. Distinct pre-tokens of many pieces are merged together."""
        for at in range(0, len(pieces), ROUND):
            part = pieces[at : at + ROUND]
            cuts = [self._cut(p) for p in part]
            new = list({t for c in cuts for t in c if t not in self.words})
            self.words.update(zip(new, self.merger.count(new).tolist(), strict=True))
            words = self.words.__getitem__
            self.known.update((p, sum(map(words, c))) for p, c in zip(part, cuts, strict=True))

    def _cut(self, piece: str) -> list[str]:
        """Pre-tokens of a piece in the vocabulary's byte alphabet; plain words need not go through the library."""
        if piece.isascii():
            core = piece[1:] if piece[:1] == " " else piece
            mark = "\u0120" if core is not piece else ""
            if core.isalpha():
                return [mark + core]
            if core[:-1].isalpha() and core[-1] in ".,;:!?":
                return [mark + core[:-1], core[-1]]
        return [t for t, _ in self.split(piece)]

    def _pieces(self, text: str) -> list[str]:
        """Parts of a text whose tokens don't depend on what stands around them.

        No pre-token crosses a single blank between two other characters, so each such blank starts a part. Longer
        runs of white space can be one pre-token; a text that has one is a single part unless it is cut elsewhere.
        """
        words = text.split(" ")
        if not self.runs(text):
            return [words[0], *map(" ".__add__, words[1:])]
        parts, held = [words[0]], words[0]
        for w in words[1:]:
            if w and held and not w[0].isspace() and not held[-1].isspace():
                parts.append(" " + w)
            else:
                parts[-1] += " " + w
            held = parts[-1]
        return parts

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; null counts as empty. A special token's string is one token, as in the library."""
        cut = []
        for text in texts:
            runs, extra = [text or ""], 0
            for s in self.merger.specials:
                if s in runs[0] or len(runs) > 1:
                    extra += sum(r.count(s) for r in runs)
                    runs = [x for r in runs for x in r.split(s)]
            cut.append((extra, [p for r in runs if r for p in self._pieces(r)]))
        for held in (self.known, self.words):
            forget(held, CACHE)
        new = set().union(*(p for _, p in cut)) - self.known.keys()
        if new:
            self._learn(sorted(new))
        known = self.known.__getitem__
        return [extra + sum(map(known, parts)) for extra, parts in cut]


def _counter(path: str) -> Callable[[], Callable[[list], list]]:
    def make() -> Callable[[list], list]:
        counter = TokenCounter(path)
        return lambda texts: [[len((t or "").encode()) for t in texts], counter.count(texts)]

    return make


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with __tsr_n_bytes and __tsr_n_tokens of each whole text; null texts have 0 of both."""
    return annotate(docs, text_col, _counter(path), [T.StructField(f"{OWN}n_bytes", T.LongType()), T.StructField(f"{OWN}n_tokens", T.LongType())])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    Null texts are empty and have no tokens; long texts are counted whole; repeated rows, and rows without id, are rows
    of their own. Other columns, whatever their names, are neither read nor returned. An empty table gives no rows.
    """
    rows = count_tokens(docs.select("doc_id", "text"), path)
    return rows.select("doc_id", F.col(f"{OWN}n_bytes").alias("n_bytes"), F.col(f"{OWN}n_tokens").alias("n_tokens"), (F.col(f"{OWN}n_tokens") > limit).alias("over_limit"))
