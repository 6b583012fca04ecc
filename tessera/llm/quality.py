"""Quality rules whose thresholds adapt to each language and source.

Five measures of a document are sketched per (lang, source) in logarithmic bins: a bin's count is the sketch, so
sketches of parts, sources or days merge by addition, in any order, with the same result, and a quantile is known
within a relative error of half a bin. A document fails where a measure lies far outside the middle half of its
group: lengths by ratio, in bins, shares by difference, as a ratio to a median of 0 means nothing. Groups with few documents borrow the merged sketch of their language, small languages that of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import OWN, annotate, keep

#: Base rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A group with fewer documents uses the sketch of its language, and a language with fewer that of the corpus.
MIN_GROUP = 200
#: Bins per factor of two, so a quantile is within 3 % of an exact one.
STEPS = 12
#: Fence: beyond this many times the distance from the median to the 90 % quantile. That distance is TAIL times the one
#: to a quartile (lengths, in bins) or the median distance (shares), as in a normal spread, so junk doesn't move it.
REACH, TAIL = 3.0, 1.9
#: A fence is never nearer to the median than this factor (in bins: two doublings).
LEAST = 2 * STEPS
#: Shares are taken per 10,000 words, and shares below this many are never too many.
SHARE, FREE_SHARE = 10_000, 500
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures that have a fence above; word_length has one below too.
LENGTHS = ("word_length", "words")
#: The share that can still fail by a fence: base rules take what repeats more. Marks have no end; one a word is taken.
CEILING = {"symbol_share": SHARE, "dup_line_share": SHARE, "repeat_share": MAX_REPEAT_PERCENT * SHARE // 100}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t\n\x0b\x0c\r"]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which stands twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    # windows are ranked by pairs, then pairs of pairs: equal ranks are equal windows, without hashing
    rank = ids
    step = 1
    while step < WINDOW:
        pair = rank[:-step] * (rank.max() + 1) + rank[step:]
        distinct, rank = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            return 0
        step *= 2
    again = np.bincount(rank)[rank] > 1
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1]) > 0))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """BASE of one whole text; null has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, int(_SYMBOL[np.frombuffer(raw, np.uint8)].sum()) if raw else 0, 0, 0
    data = np.frombuffer(raw, np.uint8)
    chars = int(np.count_nonzero(_LEAD[data])) - int(np.count_nonzero(_BLANK[data]))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, int(np.count_nonzero(_SYMBOL[data])), len(lines) - len(set(lines)), repeated_words(words)


def _make() -> Callable[[list], list]:
    return lambda texts: list(zip(*map(measure, texts), strict=True)) or [()] * len(BASE)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with BASE as __tsr_ columns."""
    return annotate(docs, text_col, _make, [T.StructField(f"{OWN}{b}", T.LongType()) for b in BASE])


def _values() -> dict[str, Column]:
    """Integer measures of a document with words; shares are per SHARE words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.floor(F.col(c) * SHARE / words)
    return {"word_length": F.floor(F.col("word_chars") * 100 / words), "symbol_share": share("n_symbols"), "dup_line_share": share("n_dup_lines"), "repeat_share": share("n_repeat_words"), "words": F.col("n_words")}


def _bin(value: Column) -> Column:
    return F.round(F.log2(value + F.lit(1.0)) * STEPS).cast("int")


def _value(at: Column) -> Column:
    """The middle of a bin in the measure's own unit."""
    return F.pow(F.lit(2.0), at / STEPS) - 1


def sketch(rows: DataFrame) -> DataFrame:
    """Sketches of rows (lang, source, BASE): lang, source, measure, bin, n. Sketches merge by summing n.

    Rows without words are not part of a sketch.
    """
    held = F.array(*[F.struct(F.lit(m).alias("measure"), _bin(v).alias("bin")) for m, v in _values().items()])
    flat = rows.filter("n_words > 0").select("lang", "source", F.explode(held).alias("x"))
    return flat.groupBy("lang", "source", "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles in bins and median distance from the median, in the measure's unit, of each key and measure, with the number of documents."""
    merged = sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    up = lambda c: F.sum("n").over(group.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda c, below, q: F.min(F.when(F.col(below) >= F.col("total") * q, F.col(c)))
    ranked = merged.withColumn("below", up("bin")).withColumn("total", F.sum("n").over(group))
    ranked = ranked.withColumn("off", F.abs(_value(F.col("bin")) - _value(at("bin", "below", 0.5).over(group))))
    ranked = ranked.withColumn("nearer", up("off"))
    return ranked.groupBy(*keys, "measure").agg(*[at("bin", "below", q).alias(c) for c, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75))], at("off", "nearer", 0.5).alias("off"), F.max("total").alias("total"))


def thresholds(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source, and fences: <length>_low and <length>_high in bins, <share>_high per SHARE words."""
    own = _quantiles(sketches, ["lang", "source"])
    lang = _quantiles(sketches, ["lang"]).select(F.col("lang").alias("l2"), F.col("measure").alias("m2"), *[F.col(c).alias(f"l_{c}") for c in ("low", "mid", "high", "off", "total")])
    whole = _quantiles(sketches.withColumn("every", F.lit(1)), ["every"]).select(F.col("measure").alias("m3"), *[F.col(c).alias(f"w_{c}") for c in ("low", "mid", "high", "off")])
    rows = own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("measure") == F.col("m2"))).join(whole, F.col("measure") == F.col("m3"))
    pick = lambda c: F.when(F.col("total") >= min_group, F.col(c)).when(F.col("l_total") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    mid, middle = pick("mid"), _value(pick("mid"))
    fence = lambda c, sign: mid + sign * F.greatest(F.lit(float(LEAST)), sign * (pick(c) - mid) * REACH * TAIL)
    most = F.greatest(F.lit(float(FREE_SHARE)), middle + pick("off") * REACH * TAIL)
    for m, top in CEILING.items():
        most = F.when((F.col("measure") == m) & (middle < top), F.least(most, (middle + top) / 2)).otherwise(most)
    rows = rows.select("lang", "source", "measure", fence("low", -1).alias("low"), fence("high", 1).alias("high"), most.alias("most"))
    of = lambda m, c, name: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{name}")
    return rows.groupBy("lang", "source").agg(*[of(m, c, c) for m in LENGTHS for c in ("low", "high")], *[of(m, "most", "high") for m in CEILING])


def judge(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """rows (lang, source, BASE) with base_failed and kept added."""
    fences = fences.withColumnRenamed("lang", "l4").withColumnRenamed("source", "s4")
    values = _values()
    high = lambda m: _bin(values[m]) > F.col(f"{m}_high")
    far = high("word_length") | (_bin(values["word_length"]) < F.col("word_length_low")) | high("words")
    for m in CEILING:
        far = far | (values[m] > F.col(f"{m}_high"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    joined = rows.join(fences, F.col("lang").eqNullSafe(F.col("l4")) & F.col("source").eqNullSafe(F.col("s4")), "left")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) to a row per row of docs: doc_id, BASE, base_failed, kept.

    Null lang and null source are groups of their own. Null and empty texts have no words and fail the base rules. Long
    texts are measured whole. Equal texts of a group have equal verdicts, and repeated rows are rows of their own, in
    sketches too; a value on a fence is kept. Other columns, whatever their names, are neither read nor returned. An
    empty table gives no rows.
    The measures are written once; sketches, fences and verdicts come from that small table.
    """
    slim = docs.select("doc_id", "text", "lang", "source")
    rows = keep(measures(slim).select("doc_id", "lang", "source", *[F.col(f"{OWN}{b}").alias(b) for b in BASE]), "quality")
    return judge(rows, thresholds(sketch(rows))).select("doc_id", *BASE, "base_failed", "kept")
