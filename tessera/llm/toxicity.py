"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

The lexicon is learned from labelled training rows: words and word beginnings that stand in toxic documents far more
often than in others. A document's features are lexicon densities, insults near a second-person word, capitals,
punctuation, and how much of the lexicon is reached only after undoing character substitutions. Trees are fitted to
logistic loss on binned features, and a monotone map from their score to a probability is fitted on rows the trees
have not seen.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import OWN, annotate, bound_batches, crc_bucket, forget, keep, send

#: Labelled rows that the model is fitted on, at most; chosen by a hash of their id.
MAX_TRAIN = 12_000
#: Fold of held-out rows: crc32(doc_id) mod FOLDS = 0.
FOLDS = 5
#: Lengths of the word beginnings that can enter the lexicon, and entries at most.
STEMS = (4, 5, 6, 7)
MAX_LEXICON = 4000
#: An entry must be this many times as frequent in toxic rows, and so surely: its rows' share of toxic ones is by this
#: many nats (rows times divergence) from the share among all rows. Fixed values.
MIN_LIFT, MIN_NATS = 15.0, 11.0
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 60, 3, 0.2, 64, 20, 1.0
#: Second-person words in the languages of the corpus. Fixed values.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus su".split())
#: Substituted characters and what they stand for. Fixed values.
SWAPS = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ("any", "share", "count", "strong", "near_you", "run", "swapped", "caps", "upper_words", "exclaim", "punctuation", "length")
_WORDS = re.compile(r"[^\W_]+(?:[@$!|*'.-][^\W_]+)*|[@$!|*][^\W_]+", re.UNICODE)
_RUN = re.compile(r"(.)\1{2,}")
NEAR = 4
SHORTEST = min(STEMS)
#: What is read of a piece with one plain word, in small letters and in capitals.
_ONE, _ONE_UPPER = (1, 0, (), ()), (1, 1, (), ())
#: Pieces between blanks that a worker remembers, and the length up to which it does.
CACHE, LONG = 400_000, 64


def plain(word: str) -> str:
    """A word in lower case, without marks inside it, substituted characters undone, longer runs of a letter cut to two."""
    return _RUN.sub(r"\1\1", re.sub(r"[*'.\-_]", "", word.lower().translate(SWAPS)))


def stems(word: str) -> list[str]:
    """Lexicon candidates of a word: itself, marked as whole, and its beginnings."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


@cache
def _capitals() -> np.ndarray:
    """Whether each code point is a capital."""
    return np.array([chr(i).isupper() for i in range(0x110000)])


class Features:
    """Features of texts by a lexicon {candidate: weight}.

    No word reaches over a blank, so a text is read piece by piece between blanks, and what a piece holds is remembered.
    """

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.known = lexicon, _Pieces(self._read)
        #: What each word of the lexicon begins with, whole where it is shorter.
        self.heads = {s.removeprefix("=")[:SHORTEST] for s in lexicon}

    def _weigh(self, word: str) -> tuple[float, bool]:
        """A word's weight in the lexicon, and whether only the undone spelling has it."""
        own = max((self.lexicon.get(s, 0.0) for s in stems(word.lower())), default=0.0)
        undone = own or max((self.lexicon.get(s, 0.0) for s in stems(plain(word))), default=0.0)
        return undone, undone > own

    def _read(self, piece: str) -> tuple[int, int, tuple, tuple]:
        """Of a piece: words, words in capitals, lexicon words (place, weight, only undone, word) and places of second persons."""
        word = piece.rstrip(".,;:!?")
        if word.isalpha():  # one word, which its undone spelling equals unless a letter runs on
            low = word.lower()
            if low[:SHORTEST] not in self.heads and low not in SECOND and not _RUN.search(low):
                return _ONE_UPPER if len(word) > 1 and word.isupper() else _ONE
        words = _WORDS.findall(piece)
        hits = tuple((i, w, undone, x.lower()) for i, x in enumerate(words) for w, undone in [self._weigh(x)] if w)
        return len(words), sum(x.isupper() and len(x) > 1 for x in words), hits, tuple(i for i, x in enumerate(words) if x.lower() in SECOND)

    def one(self, text: str | None) -> list[float]:
        text = text or ""
        forget(self.known, CACHE)
        sizes, uppers, hit, second = zip(*map(self.known.__getitem__, text.split()), strict=True) if text.strip() else ((), (), (), ())
        n_words = sum(sizes)
        n, size = max(1, n_words), max(1, len(text))
        found, near = [], 0
        if any(hit):
            starts = list(accumulate(sizes, initial=0))
            found = [(starts[k] + i, *rest) for k in compress(range(len(hit)), hit) for i, *rest in hit[k]]
            you = [starts[k] + i for k in compress(range(len(second)), second) for i in second[k]]
            near = sum(bisect_left(you, i - NEAR) < bisect_right(you, i + NEAR) for i, *_ in found)
        caps = int(_capitals()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())
        return [
            float(len({w for *_, w in found})), len(found) / n, float(len(found)), max((w for _, w, *_ in found), default=0.0),
            near / n, sum(w for _, w, *_ in found) / n, sum(u for *_, u, _ in found) / n, caps / size,
            sum(uppers) / n, (text.count("!") + text.count("?")) / size, sum(map(text.count, ".,;:")) / size, float(np.log1p(n_words)),
        ]

    def table(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.one(t) for t in texts], float).reshape(-1, len(FEATURES))


class _Pieces(dict):
    """What read says of each piece; long pieces are read anew each time."""

    def __init__(self, read: Callable[[str], tuple]) -> None:
        self.read = read

    def __missing__(self, piece: str) -> tuple:
        got = self.read(piece)
        if len(piece) <= LONG:
            self[piece] = got
        return got


class Trees:
    """Boosted regression trees on logistic loss. A tree is complete: 2**DEPTH leaves, a split per inner node."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)])
        rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._tree(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _tree(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
        node = np.zeros(len(grad), np.int64)
        feature, edge = np.full(2**DEPTH - 1, -1), np.full(2**DEPTH - 1, np.inf)
        for depth in range(DEPTH):
            n = 2**depth
            best = [(1e-6, -1, 0)] * n
            for f, b in enumerate(binned):
                width = len(self.edges[f]) + 1
                if width < 2:
                    continue
                at = node * width + b
                g, h, c = (np.bincount(at, w, n * width).reshape(n, width).cumsum(1) for w in (grad, hess, None))
                left, right = (g[:, :-1], h[:, :-1], c[:, :-1]), (g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1], c[:, -1:] - c[:, :-1])
                gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
                gain[(left[2] < MIN_LEAF) | (right[2] < MIN_LEAF)] = 0
                for k in range(n):
                    if (v := gain[k].max()) > best[k][0]:
                        best[k] = (float(v), f, int(gain[k].argmax()))
            split = np.zeros(len(node), bool)
            for k, (_, f, b) in enumerate(best):
                if f >= 0:
                    feature[n - 1 + k], edge[n - 1 + k] = f, self.edges[f][b]
                    split |= (node == k) & (binned[f] > b)
            node = node * 2 + split
        g, h = np.bincount(node, grad, 2**DEPTH), np.bincount(node, hess, 2**DEPTH)
        return (feature, edge, -RATE * g / (h + L2)), node

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for depth in range(DEPTH):
                at = 2**depth - 1 + node
                node = node * 2 + ((feature[at] >= 0) & (x[rows, feature[at]] > edge[at]))
            out += value[node]
        return out


def _pool(values: list[float], weights: list[float]) -> list[int]:
    """Sizes of the blocks of neighbours that the monotone weighted least-squares fit pools."""
    blocks: list[list[float]] = []  # weighted sum, weight, values
    for v, w in zip(values, weights, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            for k in range(3):
                blocks[-1][k] += last[k]
    return [int(b[2]) for b in blocks]


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the monotone fit of y to score: where each begins and its value, by pooling neighbours.

    Equal scores are one step from the start. Half a row of either label keeps pure steps off 0 and 1; as that pulls
    small steps further than large ones, the steps are pooled again afterwards.
    """
    first, back = np.unique(score, return_inverse=True)
    total, rows = np.bincount(back, y, len(first)), np.bincount(back, minlength=len(first)).astype(float)
    at = np.cumsum([0, *_pool((total / rows).tolist(), rows.tolist())])[:-1]
    first, total, rows = first[at], np.add.reduceat(total, at), np.add.reduceat(rows, at)
    total, rows = total + 0.5, rows + 1
    at = np.cumsum([0, *_pool((total / rows).tolist(), rows.tolist())])[:-1]
    return first[at], np.add.reduceat(total, at) / np.add.reduceat(rows, at)


class Model:
    """Lexicon, trees and calibration of one fit."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        self.lexicon, self.trees = lexicon, None
        if not len(y):
            return
        fitted = fold != 1 if len(set(y[fold == 1])) > 1 else np.ones(len(y), bool)
        self.trees = Trees().fit(x[fitted], y[fitted])
        held = ~fitted if (~fitted).any() else fitted
        self.steps, self.values = isotonic(self.trees.score(x[held]), y[held])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        score = self.trees.score(x)
        p = np.interp(score, self.steps, self.values) if len(self.steps) > 1 else np.full(len(x), self.values[0])
        return np.clip(p, 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, text, y, fold) of at most max_train labelled rows outside the held-out fold.

    Rows are chosen by a hash of their id, among the ids that docs has. Null labels and ids teach nothing; of several
    labels of an id the largest counts, of several texts the first by code point. fold 0 to 4 splits the rows again: the
    lexicon and the trees learn from all but 1, the calibration from 1.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")).filter("id is not null and y is not null")
    known = known.filter(crc_bucket(F.col("id"), FOLDS) != 0).groupBy("id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return rows.select("id", "text", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(5)).cast("int").alias("fold"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Candidates with their weights, the log of how much more frequent they are in toxic rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[1 if y else 0].update({s for w in {w.lower() for w in _WORDS.findall(text or "")} for s in stems(w)})
        names = list(seen[1])  # what no toxic row has can't enter
        yield pa.record_batch({"s": pa.array(names, pa.string()), "a": pa.array([seen[1][s] for s in names], pa.int64()), "b": pa.array([0] * len(names), pa.int64())})
        for part in _slices(list(seen[0])):
            yield pa.record_batch({"s": pa.array(part, pa.string()), "a": pa.array([0] * len(part), pa.int64()), "b": pa.array([seen[0][s] for s in part], pa.int64())})

    size = {bool(r["toxic"]): r["n"] for r in rows.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = rows.select("text", "y").mapInArrow(run, "s string, a long, b long").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    lift = ((F.col("a") + 0.5) / (size.get(True, 0) + 1.0)) / ((F.col("b") + 0.5) / (size.get(False, 0) + 1.0))
    rate = (size.get(True, 0) + 0.5) / (sum(size.values()) + 1.0)
    share = F.col("a") / (F.col("a") + F.col("b"))
    nats = F.col("a") * F.log(share / rate) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    best = counted.filter("a > 0").withColumn("lift", lift).filter((F.col("lift") >= MIN_LIFT) & (nats >= MIN_NATS))
    best = best.orderBy(F.desc(F.col("a") * F.log("lift")), "s").limit(MAX_LEXICON)
    return {r["s"]: float(np.log(r["lift"]) * np.log1p(r["a"])) for r in best.collect()}


def _slices(x: list, n: int = 50_000) -> list[list]:
    return [x[i : i + n] for i in range(0, len(x), n)]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most max_train rows. Only their features and labels come to the driver, and the lexicon."""
    bound_batches(docs.sparkSession)
    rows = keep(training_rows(docs, labels, max_train), "toxic-train")
    lexicon = learn_lexicon(rows.filter("fold != 1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(lexicon)
        for batch in batches:
            x = made.table(batch.column(1).to_pylist())
            yield pa.record_batch({"id": batch.column(0), "y": batch.column(2), "fold": batch.column(3), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    got = sorted(rows.mapInArrow(run, "id long, y int, fold int, x array<double>").collect())
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    return Model(lexicon, x, np.array([float(r["y"] > 0) for r in got]), np.array([r["fold"] for r in got], int))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __tsr_score, the probability that the whole text is toxic; null is scored as empty."""
    sent = send(docs.sparkSession, model)

    def make() -> Callable[[list], list]:
        held = sent()
        made = Features(held.lexicon)
        return lambda texts: [held.probability(made.table(texts))]

    return annotate(docs, text_col, make, [T.StructField(f"{OWN}score", T.DoubleType())])


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Without usable labels every score is 0.

    Null and empty texts have the features of a text without words, and the score that follows from them; long texts are
    read whole. Rows of equal text have equal scores. A row without doc_id is not held out. Other columns, whatever
    their names, are neither read nor returned. An empty table gives no rows.
    """
    rows = score(docs.select("doc_id", "text"), fit(docs, labels, max_train))
    predicted = (F.col(f"{OWN}score") >= 0.5).cast("int")
    return rows.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), F.col(f"{OWN}score").alias("score"), predicted.alias("predicted"))


