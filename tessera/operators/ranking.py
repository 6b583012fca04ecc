"""BM25 over one corpus: the few side is indexed in bounded blocks, the many side passes by it once for each block.

Nothing is shuffled but the best rows: a passage's tokens lie together, so it is scored against all questions of a block
where it is, and a task keeps the k best of each question. What a question still needs is known by then, so tokens whose
greatest contributions together can't reach it are not looked up, except for passages that its other tokens bring in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import bm25_tokens
from tessera.operators.retrieval import K1, B
from tessera.session import bound_batches

#: Different tokens of questions or passages in a block, all texts' together, and products of a batch held at a time.
BLOCK, PRODUCTS = 200_000, 1 << 20
#: Texts whose tokens are Python objects at one time.
ROWS = 200
#: Scores are rounded to six decimals, and ordered by that; a bound must allow for it.
SLACK = 2e-6
#: UTF-8 bytes of lower-cased text that aren't of a token become blanks.
_KEEP = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def words(text: str | None) -> list[str]:
    """bm25_tokens of a text, where Python has it."""
    return (text or "").lower().encode("utf-8", "replace").translate(_KEEP).decode("ascii").split()


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first on, n of them, and the row that each belongs to."""
    row = np.repeat(np.arange(len(first)), n)
    return first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), row


@dataclass
class Block:
    """Weights of (token, column) pairs, by token and by column."""

    names: list
    numbers: dict[str, int]
    begin: np.ndarray
    column: np.ndarray
    weight: np.ndarray
    by_column: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)
    token: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.token = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        self.by_column = np.lexsort((self.weight, self.column))
        self.starts = np.searchsorted(self.column[self.by_column], np.arange(len(self.names) + 1))

    @classmethod
    def build(cls, texts: list[tuple[object, dict[str, float]]]) -> Block:
        """Of texts (name, weights by token)."""
        numbers: dict[str, int] = {}
        rows = [(numbers.setdefault(t, len(numbers)), k, w) for k, (_, of) in enumerate(texts) for t, w in of.items() if w > 0]
        token, column, weight = (np.array(c, d) for c, d in zip(zip(*rows, strict=True) if rows else ((), (), ()), (np.int64, np.int64, np.float64), strict=True))
        order = np.argsort(token, kind="stable")
        return cls([n for n, _ in texts], numbers, np.searchsorted(token[order], np.arange(len(numbers) + 1)), column[order], weight[order])

    def essential(self, need: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that have to be looked up if columns need so much and a token gives at most its weight times most, and
        what the others can give each column."""
        bound = self.weight[self.by_column] * most
        sums = np.cumsum(bound)
        base = np.r_[0.0, sums][self.starts[:-1]]
        column = self.column[self.by_column]
        out = sums - base[column] < need[column] - SLACK
        keep = np.ones(len(bound), bool)
        keep[self.by_column] = ~out
        return keep, np.bincount(column[out], bound[out], len(self.names))

    def scores(self, tokens: list[list[str]], value, need: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and scores of all texts (tokens) and columns whose score may reach the column's need."""
        row, token, times = [], [], []
        get = self.numbers.get
        for k, of in enumerate(tokens):
            seen: dict[int, int] = {}
            for t in of:
                n = get(t)
                if n is not None:
                    seen[n] = seen.get(n, 0) + 1
            row += [k] * len(seen)
            token += seen.keys()
            times += seen.values()
        row, token = np.array(row, np.int64), np.array(token, np.int64)
        worth = value(np.array(times, np.float64), row)
        keep, rest = self.essential(need, most)
        entry, of = spread(self.begin[token], (self.begin[1:] - self.begin[:-1])[token])
        looked = keep[entry]
        entry, of = entry[looked], of[looked]
        pair = row[of] * len(self.names) + self.column[entry]
        pair, at = np.unique(pair, return_inverse=True)
        score = np.bincount(at, worth[of] * self.weight[entry], len(pair))
        r, c = np.divmod(pair, max(1, len(self.names)))
        stay = score + rest[c] >= need[c] - SLACK
        r, c, score = r[stay], c[stay], score[stay]
        # the tokens left out, of the pairs that are still in
        left = self.by_column[~keep[self.by_column]]
        starts = np.searchsorted(self.column[left], np.arange(len(self.names) + 1))
        k, of = spread(starts[c], (starts[1:] - starts[:-1])[c])
        key, have = r[of] * len(self.numbers) + self.token[left[k]], row * len(self.numbers) + token
        order = np.argsort(have, kind="stable")
        place = np.minimum(np.searchsorted(have[order], key), max(0, len(have) - 1))
        hit = have[order][place] == key if len(have) else np.zeros(0, bool)
        score = score + np.bincount(of[hit], worth[order[place[hit]]] * self.weight[left[k[hit]]], len(score))
        return r, c, np.round(score, 6)

    def slices(self, tokens: list[list[str]]) -> Iterator[tuple[int, int]]:
        """Stretches of texts that make about PRODUCTS products at most; a text that makes more is alone."""
        wide = self.begin[1:] - self.begin[:-1]
        start = total = 0
        for k, of in enumerate(tokens):
            n = int(wide[[self.numbers[t] for t in set(of) if t in self.numbers]].sum())
            if total and total + n > PRODUCTS:
                yield start, k
                start, total = k, 0
            total += n
        if len(tokens) > start:
            yield start, len(tokens)


def _blocks(texts: DataFrame, block: int) -> Iterator[list[tuple[object, dict[str, int]]]]:
    """Texts (name, tokens) as (name, how often each token stands in it), in order of name, block by block."""
    counted = texts.select("name", F.explode("tokens").alias("t")).groupBy("name", "t").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.groupBy("name").agg(F.collect_list(F.struct("t", "n")).alias("of")).orderBy("name")
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r["name"], {t: n for t, n in r["of"]}))
        size += len(r["of"])
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sent(spark: SparkSession, value: object):
    held = spark.sparkContext.broadcast(value)
    return lambda: held.value


def _idf(n: int, df: int) -> float:
    return max(0.0, float(np.log((n - df + 0.5) / (df + 0.5) + 1)))


def search_corpus(questions: DataFrame, passages: DataFrame, k: int = 3, k1: float = K1, b: float = B, block: int = BLOCK) -> DataFrame:
    """questions (qid, query) to their k best passages (title, text): qid, title, score, rank.

    Question tokens count as often as they stand in the question; ties go to the smaller title, scores of 0 are left out.
    Titles and qids must differ; rows without one are left out. Null and empty texts have no tokens but the title's.
    Questions are the few: they pass through the driver in blocks of block tokens, and passages are read twice a block,
    for how many hold each token and for the ranking. An empty table on either side gives no rows.
    """
    spark = passages.sparkSession
    bound_batches(spark)
    docs = passages.filter("title is not null").select("title", F.concat_ws(" ", "title", "text").alias("text"))
    n = average = None
    texts = questions.filter("qid is not null").select(F.col("qid").alias("name"), bm25_tokens(F.col("query")).alias("tokens"))
    kind = dict(questions.dtypes)["qid"]
    out = spark.createDataFrame([], f"qid {kind}, title string, score double")
    for held in _blocks(texts, block):
        counted = docs.select("text").mapInArrow(_count_of(_sent(spark, frozenset().union(*[of for _, of in held]))), "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
        df = dict(map(tuple, counted.collect()))
        length, n = df.pop(LENGTH, 0), df.pop(TEXTS, 0)
        average = length / n if length else 1.0
        idf = {t: _idf(n, m) for t, m in df.items()}
        made = Block.build([(q, {t: m * idf.get(t, 0.0) for t, m in of.items()}) for q, of in held])
        out = out.unionByName(docs.mapInArrow(_best_of(_sent(spark, made), to_arrow_type(questions.schema["qid"].dataType), k, k1, b, average), out.schema))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "title")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces whose tokens may be Python objects at one time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


#: Names of two sums beside the tokens' own, which no token has.
LENGTH, TEXTS = " length", " texts"


def _count_of(wanted):
    """How many of a task's texts hold each wanted token, and how many tokens and texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, length, n = wanted(), Counter(), 0, 0
        for batch in _few(batches):
            for text in batch.column(0).to_pylist():
                tokens = words(text)
                length, n = length + len(tokens), n + 1
                found.update(keys.intersection(tokens))
        found.update({LENGTH: length, TEXTS: n})
        yield pa.record_batch({"t": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    return run


def _best_of(held, kind: pa.DataType, k: int, k1: float, b: float, average: float):
    """A task's k best passages of each question of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held()
        best: list[list[tuple[float, str]]] = [[] for _ in block.names]
        need = np.zeros(len(block.names))
        for batch in _few(batches):
            titles, tokens = batch.column(0).to_pylist(), list(map(words, batch.column(1).to_pylist()))
            for low, high in block.slices(tokens):
                length = np.array([len(t) for t in tokens[low:high]], np.float64)
                value = lambda tf, row: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))  # noqa: E731, B023
                for r, c, s in zip(*(x.tolist() for x in block.scores(tokens[low:high], value, need, k1 + 1)), strict=True):
                    if s > 0 and s >= need[c]:
                        own = best[c]
                        own.append((-s, titles[low + r]))
                        own.sort()
                        del own[k:]
                        if len(own) == k:
                            need[c] = -own[-1][0]
        rows = [(block.names[c], t, -s) for c, own in enumerate(best) for s, t in own]
        qid, title, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(qid, kind), pa.array(title, pa.string()), pa.array(score, pa.float64())], names=["qid", "title", "score"])

    return run


def with_best_passage(rows: DataFrame, qid: str, query: str, passages: DataFrame, k1: float = K1, b: float = B, block: int = BLOCK) -> DataFrame:
    """rows with title and score of best_passage, null where a row has none; qid and query name its columns.

    Where the passages are one block, all columns pass through where the row is, so nothing is shuffled. With more, rows
    pass by each block, and the best of all are joined by qid, which must differ then. Rows whose qid is null have none.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    none = {"title": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}
    by = lambda made, of: of.mapInArrow(_better_in(_sent(spark, made), of.columns.index(qid), of.columns.index(query)), of.schema)
    blocks = _passage_blocks(spark, passages, k1, b, block)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return rows.withColumns(none) if first is None else by(first, rows.withColumns(none))
    found = None
    for made in chain((first, second), blocks):
        own = by(made, rows.select(qid, query).withColumns(none)).filter("title is not null").select(qid, "title", "score")
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy(qid).orderBy(F.desc("score"), "title")
    best = found.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
    return rows.join(best, qid, "left").select(*rows.columns, "title", "score")


def best_passage(questions: DataFrame, passages: DataFrame, k1: float = K1, b: float = B, block: int = BLOCK) -> DataFrame:
    """search_corpus with k = 1 where the passages are the few and the questions (qid, query) the many: qid, title, score.

    Passages pass through the driver in blocks of block tokens, and questions pass by each block, where they are.
    """
    of = with_best_passage(questions.select("qid", "query"), "qid", "query", passages, k1, b, block)
    return of.filter("title is not null").select("qid", "title", "score")


def _passage_blocks(spark: SparkSession, passages: DataFrame, k1: float, b: float, block: int) -> Iterator[Block]:
    """Passages, the few, as blocks of the weights of their tokens."""
    docs = passages.filter("title is not null").select(F.col("title").alias("name"), bm25_tokens(F.concat_ws(" ", "title", "text")).alias("tokens")).persist()
    n, average = docs.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).first()
    average = average or 1.0
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).persist()
    share = lambda tf, of: tf * (k1 + 1) / (tf + k1 * (1 - b + b * sum(of.values()) / average))
    for held in _blocks(docs, block):
        wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*[of for _, of in held]))], "t string")
        idf = {t: _idf(n, m) for t, m in map(tuple, df.join(F.broadcast(wanted), "t").collect())}
        yield Block.build([(title, {t: idf[t] * share(m, of) for t, m in of.items()}) for title, of in held])
    docs.unpersist()
    df.unpersist()


def _better_in(held, qid: int, query: int):
    """Rows whose last two columns, title and score, become those of their best passage of a block where it is better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held()
        none = np.zeros(len(block.names))
        order = np.argsort(np.array(block.names, object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # of titles, for ties
        for batch in _few(batches):
            tokens = [[] if q is None else words(t) for q, t in zip(batch.column(qid).to_pylist(), batch.column(query).to_pylist(), strict=True)]
            *rest, titles, scores = batch.columns
            titles, scores = titles.to_pylist(), scores.to_pylist()
            for low, high in block.slices(tokens):
                r, c, s = block.scores(tokens[low:high], lambda tf, row: tf, none, 0.0)
                r, c, s = r[s > 0], c[s > 0], s[s > 0]
                by = np.lexsort((place[c], -s, r))
                first = by[np.flatnonzero(np.r_[True, r[by][1:] != r[by][:-1]])] if len(by) else by
                for k, i, score in zip((low + r[first]).tolist(), c[first].tolist(), s[first].tolist(), strict=True):
                    if titles[k] is None or (-score, block.names[i]) < (-scores[k], titles[k]):
                        titles[k], scores[k] = block.names[i], score
            yield pa.RecordBatch.from_arrays([*rest, pa.array(titles, pa.string()), pa.array(scores, pa.float64())], names=batch.schema.names)

    return run
