"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A three-letter gram is bound by multiplying its letters' vectors,
each rotated by its place; a text's profile bundles (adds) its grams' vectors; a language's prototype bundles its
training texts' unit profiles. A text gets the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import OWN, annotate, bound_batches, crc_bucket, pieces, send

#: Dimensions of a vector, and letters bound into a gram.
DIMENSIONS, GRAM = 1024, 3
#: Fold of held-out rows: crc32(doc_id) mod FOLDS = HELD.
FOLDS, HELD = 4, 2
#: Training rows of a language, about; chosen by a hash of their id.
MAX_TRAIN = 2000
#: Documents whose grams are bundled in one matrix product.
BUNDLE = 64
UNKNOWN = "und"
#: Languages that a model can hold; more are an error, not cut off.
MAX_LANGUAGES = 10_000


def letter_vector(code: int) -> np.ndarray:
    """The vector of a character, the same everywhere; 0 stands for everything between words."""
    return np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1


class Bundler:
    """Profiles of texts. Vectors of grams that have been seen are remembered, up to a bound."""

    #: Gram vectors held, 4 kB each.
    HELD = 16_000

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((1024, DIMENSIONS), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = letter_vector(code)
        return self.letters[code]

    def _bind(self, gram: int) -> np.ndarray:
        """Gram vector: the product of its letters' vectors, the first rotated twice, the second once."""
        codes = [(gram >> (21 * k)) & 0x1FFFFF for k in (2, 1, 0)]
        out = np.ones(DIMENSIONS, np.float32)
        for k, c in enumerate(codes):
            out *= np.roll(self._letter(c), GRAM - 1 - k)
        return out

    def _at(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the matrix that hold these distinct grams' vectors."""
        if len(self.rows) + len(grams) > self.HELD:
            self.rows.clear()
        for g in grams.tolist():
            if g not in self.rows:
                k = self.rows[g] = len(self.rows)
                if k >= len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                self.matrix[k] = self._bind(g)
        return np.fromiter((self.rows[g] for g in grams.tolist()), np.int64, len(grams))

    @staticmethod
    def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the lower-cased texts, 0 for whatever isn't a letter, runs of 0 cut to one; and their text."""
        low = [f" {(t or '').lower()} " for t in texts]
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
        kinds, back = np.unique(code, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
        code = np.where(letter[back], code, 0)
        stay = np.r_[True, (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])] if len(code) else np.zeros(0, bool)
        return code[stay], owner[stay]

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; a text without letters has a zero row."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for at in range(0, len(texts), BUNDLE):
            part = texts[at : at + BUNDLE]
            code, owner = self._codes(part)
            if len(code) < GRAM:
                continue
            kinds, small = np.unique(code, return_inverse=True)
            n = len(kinds)
            inside = (owner[2:] == owner[:-2]) & ((code[1:-1] != 0) | ((code[:-2] != 0) & (code[2:] != 0)))
            key = ((small[:-2] * n + small[1:-1]) * n + small[2:])[inside]
            text = owner[:-2][inside]
            if not len(key):
                continue
            if n**3 <= 1 << 21:
                place = np.zeros(n**3, np.int64)
                place[key] = 1
                distinct = np.flatnonzero(place)
                place[distinct] = np.arange(len(distinct))
                index = place[key]
            else:
                distinct, index = np.unique(key, return_inverse=True)
            grams = (kinds[distinct // (n * n)] << 42) | (kinds[distinct // n % n] << 21) | kinds[distinct % n]
            counts = np.bincount(text * len(distinct) + index, minlength=len(part) * len(distinct)).reshape(len(part), -1).astype(np.float32)
            for k in range(0, len(grams), self.HELD // 2):
                rows = self._at(grams[k : k + self.HELD // 2])
                out[at : at + len(part)] += counts[:, k : k + self.HELD // 2] @ self.matrix[rows]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def prototypes(docs: DataFrame, max_train: int = MAX_TRAIN) -> dict[str, np.ndarray]:
    """Unit prototype of each non-null lang, learned from about max_train texts of it outside the held-out fold.

    Only the sums, DIMENSIONS numbers per language and task, leave the executors. Texts without letters add nothing.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null and doc_id is not null")
    rows = rows.filter(crc_bucket(F.col("doc_id"), FOLDS) != HELD)
    # a prototype per language comes to the driver anyway, so the languages' counts may
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    if not counts:
        return {}
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 30, (max_train << 30) // r["n"]))])
    # rows are chosen where they are: no text is shuffled
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rates[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(), {}
        for batch in batches:
            for piece in pieces(batch, 1):
                langs = np.array(piece.column(0).to_pylist(), object)
                made = unit(bundler.profiles(piece.column(1).to_pylist()))
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + made[langs == lang].sum(0, dtype=np.float64)
        names = sorted(sums)
        yield pa.record_batch({"lang": pa.array(names, pa.string()), "v": pa.array([sums[s].tolist() for s in names], pa.list_(pa.float64()))})

    parts = chosen.mapInArrow(run, "lang string, v array<double>")
    place = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in place.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = round(r["x"], 6)
    return {s: unit(out[s][None])[0].astype(np.float32) for s in sorted(out) if np.any(out[s])}


def identify(docs: DataFrame, protos: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with __tsr_lang and __tsr_score: the best prototype and its cosine, from 0 to 1.

    Null texts and texts without a letter get UNKNOWN and 0, as all do if there is no prototype. Of languages with
    equal cosines the first by code point is taken.
    """
    sent = send(docs.sparkSession, protos)

    def make() -> Callable[[list], list]:
        held = sent()
        names = list(held)
        matrix = np.stack([held[s] for s in names]).T if names else None
        bundler = Bundler()

        def call(texts: list) -> list:
            if matrix is None:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
            made = bundler.profiles(texts)
            known = [any(map(str.isalpha, t or "")) for t in texts]
            cosine = unit(made) @ matrix
            best = cosine.argmax(1)
            top = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
            return [[names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(x) if k else 0.0 for x, k in zip(top, known, strict=True)]]

        return call

    return annotate(docs, text_col, make, [T.StructField(f"{OWN}lang", T.StringType()), T.StructField(f"{OWN}score", T.DoubleType())])


def languages(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Null texts and texts without a letter are UNKNOWN with score 0; long texts are read whole. Rows of equal text have
    equal predictions. A row without doc_id teaches nothing and is not held out. Without training rows all are UNKNOWN.
    Other columns, whatever their names, are neither read nor returned. An empty table gives no rows.
    """
    rows = identify(docs.select("doc_id", "text"), prototypes(docs, max_train))
    held = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col(f"{OWN}lang").alias("lang_pred"), F.col(f"{OWN}score").alias("score"))
