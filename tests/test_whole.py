"""Queries over whole texts, held against plain Python."""

import math
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.plans.catalogue import QUERIES

HEAD = "one two three four five six seven eight"
ITEMS = [(0, f"{HEAD} zebra lion owl"), (1, f"{HEAD} crane heron"), (2, None), (3, "Ärger über Öl")]
DOCS = [
    (0, HEAD), (1, "zebra lion owl " * 3), (2, f"so {HEAD} zebra lion owl it is"), (3, f"{HEAD} but then no more of it than that"), (4, "crane heron"), (5, None), (6, ""),
    (7, f"{HEAD} crane heron"), (8, "Ärger über Öl"), (9, "日本 «L'été» The\u00a0Straße à la carte, ÑANDÚ a-n"), (10, f"{HEAD} {'filler ' * 40}zebra lion owl"),
]


@pytest.fixture(scope="module")
def whole_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    langs = ["en", None, "de", "fr"]
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, t, langs[i % 4]) for i, t in DOCS], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def tables(spark, d):
    return [[tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(i, "text").collect()] for t, i in (("benchmark", "item_id"), ("documents", "doc_id"))]


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def bm25(questions, passages, k):
    """questions (qid, text) and passages (title, text) to qid: [(title, score), ...]."""
    toks = {t: tokens(f"{t} {x or ''}") for t, x in passages}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    tf = {t: Counter(x) for t, x in toks.items()}
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for q, x in questions:
        asked = Counter(tokens(x))
        score = {t: round(sum(m * max(0, math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(toks[t]) / avgdl)) for w, m in asked.items() if w in c), 6) for t, c in tf.items()}
        out[q] = sorted(((t, s) for t, s in score.items() if s > 0), key=lambda r: (-r[1], r[0]))[:k]
    return out


@pytest.mark.parametrize("small", [True, False])
def test_search_takes_whole_items(spark, whole_dir, sf_dir, small):
    d = whole_dir if small else sf_dir
    items, docs = tables(spark, d)
    want = bm25(items, [(f"doc {i}", t) for i, t in docs], 3)
    got = {(r.qid, r["rank"]): (r.title, r.score) for r in QUERIES["bm25_topk"](spark, d).collect()}
    assert {k: t for k, (t, _) in got.items()} == {(q, k + 1): t for q, ts in want.items() for k, (t, _) in enumerate(ts)}
    assert all(s == pytest.approx(want[q][k - 1][1], abs=2e-6) for (q, k), (_, s) in got.items())
    obs = {r.qid: r.obs for r in QUERIES["search_observation_text"](spark, d).collect()}
    assert obs == {q: "\n".join(["search results:", *(f"[{k + 1}] {t}" for k, (t, _) in enumerate(ts))]) for q, ts in want.items() if ts}
    rate = {}
    for q, x in items:
        gold = [f"doc {i}" for i, t in docs if x is not None and t is not None and x in t]
        rate[q] = (len(gold), round(sum(t in gold for t, _ in want[q]) / len(gold), 6) if gold else 1.0)
    assert {r.qid: (r.n_gold, r.hit_rate) for r in QUERIES["bm25_hit_rate"](spark, d).collect()} == rate
    if small:
        assert rate[0][0] == 1  # documents 0 and 3 hold the head alone


def norm(text):
    low = "".join(c for c in (text or "").lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", low).split())


def share(a, b):
    return round(sum(w in b for w in a) / len(a), 6) if a else 0.0


def f1(a, b):
    same = sum((Counter(a) & Counter(b)).values())
    return (1.0 if a == b else 0.0) if not a or not b else round(2 * same / (len(a) + len(b)), 6)


@pytest.mark.parametrize("small", [True, False])
def test_scores_take_whole_texts_of_every_document(spark, whole_dir, sf_dir, small):
    d = whole_dir if small else sf_dir
    items, docs = tables(spark, d)
    best = bm25(docs, [(f"item {i}", t) for i, t in items], 1)
    pairs = [(i, int(best[i][0][0][5:]) if best[i] else None, t) for i, t in docs]
    pred = {**dict(items), None: None}
    words = {"em": lambda p, g: norm(p) == norm(g), "f1": lambda p, g: f1(norm(p).split(), norm(g).split()), "recall": lambda p, g: share(norm(p).split(), norm(g).split()), "score": lambda p, g: share(tokens(p), tokens(g))}
    for name, (col, of) in zip(("exact_match", "token_f1", "answer_recall", "citation_alignment_overlap"), words.items()):
        got = {r.doc_id: (r.item_id, r[col]) for r in QUERIES[f"{name}"](spark, d).collect()}
        assert got == {i: (k, pytest.approx(of(pred[k], t), abs=2e-6)) for i, k, t in pairs}, name


@pytest.mark.parametrize("small", [True, False])
def test_answers_of_every_language_are_normalized(spark, whole_dir, sf_dir, small):
    d = whole_dir if small else sf_dir
    got = {r.doc_id: r.norm for r in QUERIES["normalize_answer"](spark, d).collect()}
    assert got == {i: norm(t) for i, t in tables(spark, d)[1]}


def corpus(seed=1, n=300):
    """Passages of common and rare words, some equal, and questions of many lengths."""
    import random

    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "it"], [f"w{i}" for i in range(200)]
    text = lambda k: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(k))
    passages = [(f"p{i:03d}", text(rng.randrange(1, 60))) for i in range(n)]
    passages += [("same b", passages[0][1]), ("same a", passages[0][1]), ("empty", ""), ("null", None), ("pé", "w1 w1 w1")]
    questions = [(i, text(rng.randrange(1, 40))) for i in range(25)] + [(90, "the the of"), (91, None), (92, "nothing here"), (93, passages[0][1])]
    return passages, questions


@pytest.mark.parametrize("block,products", [(200_000, 1 << 20), (30, 50)])
def test_ranking_drops_nothing(spark, monkeypatch, block, products):
    from tessera.operators import ranking as K

    monkeypatch.setattr(K, "PRODUCTS", products)
    passages, questions = corpus()
    p, q = spark.createDataFrame(passages, "title string, text string").repartition(3), spark.createDataFrame([*questions, (None, "w1")], "qid int, query string")
    want = bm25(questions, passages, 4)
    got = {}
    for r in K.search_corpus(q, p.unionByName(spark.createDataFrame([(None, "w1")], p.schema)), 4, block=block).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["title"], r["score"]))
    assert {k: [t for t, _ in v] for k, v in got.items()} == {k: [t for t, _ in v] for k, v in want.items() if v}
    assert all(s == pytest.approx(x, abs=2e-6) for k in got for (_, s), (_, x) in zip(got[k], want[k]))
    best = {r["qid"]: r["title"] for r in K.best_passage(q, p, block=block).collect()}
    assert best == {k: v[0][0] for k, v in want.items() if v}
    assert K.search_corpus(q.limit(0), p).count() == K.search_corpus(q, p.limit(0)).count() == K.best_passage(q, p.limit(0)).count() == 0


def test_ranking_leaves_common_tokens_out(spark):
    import numpy as np

    from tessera.operators import ranking as K

    block = K.Block.build([("q", {"the": 0.1, "w1": 3.0, "w2": 2.0})])
    keep, rest = block.essential(np.array([2.0]), 2.5)
    assert {t for t, n in block.numbers.items() if keep[block.begin[n]]} == {"w1", "w2"} and rest[0] == pytest.approx(0.25)
    value = lambda tf, row: tf
    assert [x.tolist() for x in block.scores([["the", "of"], ["w1", "the"]], value, np.array([2.0]), 2.5)] == [[1], [0], [3.1]]


@pytest.mark.parametrize("most", [200_000, 0])
def test_held_texts(spark, monkeypatch, most):
    from tessera.operators import containment
    from tessera.operators.containment import containing

    monkeypatch.setattr(containment, "MOST_ROWS", most)

    texts = [("a", "xx one two three yy"), ("b", "one two threefold"), ("c", "one  two three"), ("d", None), ("e", "!!"), ("f", "none two t")]
    held = [(1, "one two three"), (2, "ne two t"), (3, "!"), (4, None), (5, ""), (6, "one"), (7, "zz one two qq"), (1, "one two three")]
    got = sorted(map(tuple, containing(spark.createDataFrame(texts, "title string, text string"), spark.createDataFrame(held, "qid int, held string")).select("qid", "title").collect()))
    assert got == sorted((q, t) for q, h in held if h is not None for t, x in texts if x is not None and h in x)


def test_overlaps_by_counts(spark):
    from tessera.operators import overlap as O

    rows = [(1, None, ["a", "a", "b"], ["a", "c", "a", "a"]), (2, 5, [], ["x"]), (3, 5, None, None), (4, 6, ["a"], []), (5, 7, ["q"] * 3, ["q"])]
    over = O.overlaps(spark.createDataFrame(rows, "i int, k int, a array<string>, b array<string>"), "i", "k")
    got = {r["i"]: tuple(r)[1:] for r in over.select("i", "k", "n_a", "n_b", "same", "a_in_b", O.f1(over).alias("f"), O.recall(over).alias("r")).collect()}
    assert got == {1: (None, 3, 4, 2, 2, pytest.approx(4 / 7), pytest.approx(2 / 3)), 2: (5, 0, 1, 0, 0, 0.0, 0.0), 3: (5, 0, 0, 0, 0, 1.0, 0.0), 4: (6, 1, 0, 0, 0, 0.0, 0.0), 5: (7, 3, 1, 1, 3, 0.5, 1.0)}


def test_words_are_the_tokens_of_a_text(spark):
    from tessera.functions.text import bm25_tokens
    from tessera.operators.ranking import words

    texts = ["", None, "A-b_c9 Ärgerİx Kelvin z\U0001f600q", "The\tend.\r\n1,5", "日本 L'été"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bm25_tokens(F.col("t")).alias("w")).collect()
    assert all(words(r["t"]) == r["w"] for r in rows)


def test_best_texts_and_overlaps_shuffle_no_document(spark, whole_dir):
    """All that moves between tasks is of the few side."""
    from tessera.operators import overlap as O
    from tessera.operators import ranking as K

    docs, items = spark.read.parquet(f"{whole_dir}/documents.parquet"), spark.createDataFrame(ITEMS, "title string, text string")
    best = K.with_best_passage(docs, "doc_id", "text", items)
    over = O.overlaps(best.selectExpr("doc_id", "split(title, ' ') AS a", "split(text, ' ') AS b"), "doc_id")
    assert best.columns == [*docs.columns, "title", "score"]
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (best, over))
