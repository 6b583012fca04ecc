import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import chat, common, decontaminate, language, mixing, neardup, quality, repeats, token_count, token_files, toxicity
from tessera.llm.queries import QUERIES
from tests.llm import brute

ODD = [None, "", " ", "\n\n", "a", "don't  stop\n \nnow", "<|endoftext|> x", "日本語 テスト é", "x\x1cy \x85 z", "# $ | <>", "same line\nsame line\nsame line"]


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(20, 160))) for _ in range(n)]


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(("zz" + str(r.randint(0, 99)) if r.random() < share else w) for w in text.split(" "))


def corpus():
    """Prose, exact copies, chains of near copies, a shared passage, odd texts, a repeated row, a null id, one long text."""
    base = prose(1, 60)
    texts = base + base[:5] * 3
    for k in range(12):
        texts += [edited(base[k], 7 * k + j, 0.02 * (j + 1)) for j in range(4)]
    chain = base[20]
    for j in range(8):
        chain = edited(chain, 90 + j, 0.03)
        texts.append(chain)
    passage = " ".join(prose(5, 3))[:700]
    texts += [base[30] + " " + passage + " " + base[31], passage, base[32] + " " + passage, passage[:260] + base[33], "ab" * 400, base[34].upper()]
    texts += ODD + [" ".join(prose(8, 40))]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], ["a", "b", None, "é"][k % 4], "x", 5) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, component_id int").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_near_duplicates(docs, empty):
    got = rows_of(neardup.near_duplicates(docs))
    assert got == brute.near_duplicates(corpus())
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_open_buckets(docs):
    assert rows_of(neardup.near_duplicates(docs, rounds=0)) == brute.near_duplicates(corpus())


def test_near_duplicates_many_texts_of_one_id(spark):
    texts = prose(3, 12)
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (4, texts[2]), (5, edited(texts[2], 1, 0.01))]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4)} <= got


def test_components_that_share_an_id_are_one(spark):
    a, b, c = prose(13, 3)
    rows = [(10, a), (10, b), (10, c), (1, a), (2, b), (3, c), (4, ""), (4, c + " x"), (10, "")]
    got = rows_of(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.near_duplicates(rows) and {r[2] for r in got} == {1}


def test_keep_one_keeps_one_row(spark, docs, empty):
    a, b = prose(14, 2)
    rows = [(7, a, 1), (7, a, 1), (7, a, 2), (9, a, 3), (5, b, 4), (None, a, 5), (None, a, 5), (8, "", 6), (8, None, 7)]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, __tsr_gone int")).collect()
    assert sorted((r.doc_id for r in got), key=str) == [5, 7, 8, None, None]
    kept = neardup.keep_one(docs)
    want = {i for i, _, _, k in brute.near_duplicates(corpus()) if k}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and set(ids) == want and len([i for i in ids if i is not None]) == len(want - {None})
    assert neardup.keep_one(empty).count() == 0


def test_hot_keys_are_dealt_out(spark):
    many = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id) AS k", "id AS v")
    one = many.select("k").distinct().selectExpr("k", "k * 2 AS w")
    got = common.salted_join(many, one, ["k"])
    assert "__tsr_salt" in got._jdf.queryExecution().toString()
    assert rows_of(got.select("k", "v", "w")) == rows_of(many.join(one, "k").select("k", "v", "w"))
    assert rows_of(common.salted_join(many, one.filter("k > 5"), ["k"], "left").select("k", "v", "w")) == rows_of(many.join(one.filter("k > 5"), "k", "left").select("k", "v", "w"))
    assert common.salted_join(many, one.filter("k = 1"), ["k"], "left_semi").count() == 1001


def test_own_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "one two", [5], "x")], "doc_id long, text string, __tsr_items array<long>, __tsr_score string")
    bench = spark.createDataFrame([(3, "one two")], "item_id long, text string")
    once = decontaminate.find_leaks(docs, bench)
    twice = decontaminate.find_leaks(once, bench)
    assert rows_of(once) == rows_of(twice) and once.columns == twice.columns and once.first()["__tsr_items"] == [3]


SETTINGS = """
from pyspark.sql import SparkSession
import tempfile, sys
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
if sys.argv[1] == "set":
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
from tessera.llm import common
kept = common.keep(spark.range(3), "x")
assert kept.count() == 3 and spark.conf.get("spark.checkpoint.dir", None) is None
folder = common._folder(spark).removeprefix("file:").replace("//", "/")
print("FOLDER", folder)
"""


@pytest.mark.parametrize("how", ["unset", "set"])
def test_scratch_without_settings(how, tmp_path):
    import os
    import subprocess
    import sys

    got = subprocess.run([sys.executable, "-c", SETTINGS, how], capture_output=True, text=True, timeout=120, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    folder = [line.split()[1] for line in got.stdout.splitlines() if line.startswith("FOLDER")]
    assert folder and not os.path.exists(folder[0]), got.stderr[-2000:]


def test_min_max_signature_estimates_similarity():
    r = np.random.Generator(np.random.PCG64(1))
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    got = np.mean([np.mean(neardup.signature(pool[k : k + 800]) == neardup.signature(pool[k + 100 : k + 900])) for k in range(0, 3000, 100)])
    assert abs(got - 700 / 900) < 0.03


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41) if i in got) and got[200] == got[150] == 100


def test_mix(spark, docs, empty):
    got = mixing.plan_mix(docs, rows_per_range=7).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert rows_of(got) == sorted(map(tuple, con.sql(mixing.ORACLE).fetchall()), key=str)
    assert mixing.plan_mix(empty).count() == 0 == mixing.mix(empty).count()
    per = mixing.plan_mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s")).collect()
    assert all(r.t == int(r.g) and r.g <= 3 * r.s for r in per)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in words} == {r.source: r.t for r in per if r.t}


def test_source_targets_reshare_until_none_is_above(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got["a"] == 30 and got["b"] == 300 and abs(got["c"] - 780) < 1e-9 and got[None] == 0


def test_token_counts(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = sorted(((i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in corpus()), key=str)
    assert rows_of(token_count.token_counts(docs, path)) == want
    assert token_count.token_counts(empty, path).count() == 0


def test_token_counts_of_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, counter, r = Tokenizer.from_file(path), token_count.TokenCounter(path), random.Random(2)
    texts = ["".join(r.choice("ab '\n\t 1é日 !<|> 　sll\x1c") for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["a" * 5000, "ab" * 3000]
    assert counter.count(texts) == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_decontamination(spark, empty):
    items = prose(11, 12) + ["too short an item", None, "", "zz-top  again"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = prose(12, 30)
    swapped = " ".join("xx" if k % 7 == 3 else w for k, w in enumerate(items[2].split(" ")))
    leaks = {100: {0}, 101: {1}, 102: {2}, 103: {3, 4}, 104: {12, 15}}
    texts = {100: clean[0] + " " + items[0] + ". " + clean[1], 101: items[1].upper().replace(" ", ", "), 102: clean[2] + " " + swapped, 103: items[3] + " " + items[4], 104: "Too short: an item, ZZ top again", 105: "too short item zz again top"}
    rows = [(i, t) for i, t in enumerate(clean)] + list(texts.items()) + [(900 + k, t) for k, t in enumerate(ODD)] + [(None, items[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (500_000, 60):
        found = decontaminate.find_leaks(docs, bench, block_words=block).collect()
        got = {r["doc_id"]: set(r["__tsr_items"]) for r in found if r["__tsr_items"]}
        assert got == leaks | {None: {5}}
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def plain_leaks(items, text):
    """Items that text overlaps: every diagonal is compared, and stretches of all diagonals are chained."""
    fold = decontaminate.Words()
    words, out = fold.hashes([text])[0], set()
    for k, item in enumerate(items):
        x = fold.hashes([item])[0]
        n, best, parts = len(x), 0, []
        for shift in range(-n + 1, len(words)):
            row, at = [], 0
            for i in range(max(0, -shift), min(n, len(words) - shift)):
                row.append((i, x[i] == words[i + shift]))
            for a in range(len(row)):  # every stretch from a match to a match
                score = matched = 0
                for b in range(a, len(row)):
                    score += 1 if row[b][1] else -decontaminate.MISMATCH
                    matched += bool(row[b][1])
                    if score <= 0:
                        break
                    if score > at:
                        at, found = score, (matched, row[a][0], row[b][0] + 1, shift)
            if at >= 6:
                parts.append(found)
            best = max(best, found[0] if at else 0)
        need = n if n < decontaminate.MIN_ITEM else min(decontaminate.MIN_MATCH, decontaminate.MIN_SHARE * n)
        if n and max(best, decontaminate.chained(parts) if n >= decontaminate.MIN_ITEM else 0) >= need:
            out.add(k)
    return out


def test_decontamination_recall(spark):
    r = random.Random(21)
    items = [" ".join(t.split(" ")[: r.randint(9, 40)]) for t in prose(22, 14)] + ["one two three"]
    filler = prose(23, 70)
    texts = []
    for k in range(70):
        w = items[k % len(items)].split(" ")
        if k % 5 == 1:
            w = [x if r.random() > 0.12 else "qq" for x in w]
        if k % 5 == 2:
            del w[len(w) // 2]
        if k % 5 == 3:
            w.insert(len(w) // 2, "ww")
        if k % 5 == 4:
            w = w[: len(w) // 3]
        texts.append(" ".join([*filler[k].split(" ")[:12], *w, *filler[k].split(" ")[12:20]]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r.doc_id: set(r["__tsr_items"]) for r in decontaminate.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    want = {k: plain_leaks(items, t) for k, t in enumerate(texts)}
    n = sum(map(len, want.values()))
    hit = sum(len(found[k] & want[k]) for k in want)
    assert n >= 40 and hit >= 0.9 * n and not any(found[k] - want[k] for k in want)


def test_apostrophes_are_alike(spark):
    item = "it's not what you'd think of when you're away from all that's known"
    docs = spark.createDataFrame([(1, "so " + item.replace("'", "\u2019"))], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert got.contaminated and got["items"] == [5]


def test_chat(spark):
    c = [("system", "s"), ("user", "hello"), ("assistant", "hi <|im_end|>"), ("user", None)]
    rows = []
    for conv, n in ((1, 2), (2, 4), (3, 3), (4, 4), (5, 1)):
        rows += [(conv, k, *c[k], "extra") for k in range(n)]
    rows += [(6, 0, "user", "hello", "e"), (6, 0, "user", "hello", "e"), (7, None, None, None, "e"), (None, 1, "user", "no id", "e")]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = rows_of(chat.format_chat(convs))
    con = duckdb.connect()
    import pandas as pd

    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "n_turns"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert got == sorted(map(tuple, con.sql(chat.ORACLE).fetchall()), key=str)
    by = {r[0]: r for r in got}
    assert set(by) == {2, 6, 7, None} and by[2][2] == 2 and by[6][1] == 1
    assert by[2][3] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user\n<|im_end|>"
    assert chat.format_chat(convs.limit(0)).count() == 0


@pytest.mark.parametrize("in_task", [2000, 1])
def test_repeats(docs, in_task):
    assert rows_of(repeats.remove_repeats(docs, in_task=in_task)) == brute.removals(corpus())


def test_repeats_long_and_periodic(spark, monkeypatch):
    r = random.Random(4)
    noise = ["".join(r.choice("abcdefgh ") for _ in range(3000)) for _ in range(6)]
    rows = [(0, noise[0] + noise[1]), (1, noise[1][100:900] + "é" * 300), (2, "é" * 150), (3, noise[2] + noise[2]), (4, "ab" * 1000), (5, "b" + noise[3][:199]), (6, noise[3][:199]), (7, noise[3][:200]), (8, noise[4][:199] + "x" + noise[4][:200])]
    assert rows_of(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.removals(rows)
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_ranks_are_a_suffix_array():
    r = random.Random(9)
    for _ in range(60):
        depth = r.choice([1, 5, 8, 13, 40, 200])
        text = bytes(r.choice(b"ab") for _ in range(r.randint(depth, 400)))
        begin = sorted(r.sample(range(len(text) - depth + 1), r.randint(1, len(text) - depth + 1)))
        rank = repeats.suffix_ranks(np.frombuffer(text, np.uint8), np.array(begin), depth)
        cut = [text[b : b + depth] for b in begin]
        order = {x: k for k, x in enumerate(sorted(set(cut)))}
        assert rank.tolist() == [order[x] for x in cut]
        assert repeats._again(rank).tolist() == [cut.count(x) > 1 for x in cut]


def test_parse_cuts_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 700)
    r = random.Random(6)
    raw = bytes(r.choice(b"abcdef") for _ in range(5000))
    found = repeats.parse([raw, b"short", raw[:650]])
    for text, n in ((0, 5000), (2, 650)):
        mine = found.text == text
        starts = sorted(s for b, w in zip(found.begin[mine], found.windows[mine]) for s in range(b, b + w))
        assert starts == list(range(n - 199))


def test_quality_base(docs, empty):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect()), key=str)
    want = [(i, *(b := brute.quality_base(t)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for i, t in corpus()]
    assert got == sorted(want, key=str)
    assert quality.quality(empty).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefg") for _ in range(n))
    text = lambda n: " ".join(word(max(1, n + r.randint(-1, 1))) for _ in range(60))
    rows = [(i, text(4 if i % 2 else 40), "en", "short" if i % 2 else "long") for i in range(800)] + [(9000, text(40), "en", "short"), (9001, text(4), "en", "long"), (9002, "# | " * 30, "en", "short")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(800)) and not got[9000] and not got[9001] and not got[9002]


@pytest.mark.parametrize("junk", [15, 30])
def test_quality_fences_stand_where_a_group_holds_junk(spark, junk):
    r = random.Random(junk)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))

    def text(kind):
        w = [word() for _ in range(200)]
        if kind == "repeat":  # 8 % to 28 % of the words stand in a repeated window
            n = r.randint(8, 28)
            w[100 : 100 + n] = w[:n]
        if kind == "symbol":
            w[::10] = ["#"] * 20
        return ("\n".join([*w[:180], *["same"] * 20]) if kind == "line" else " ".join(w))

    rows = [(400 * g + i, text(kind if i % 100 < junk else "clean"), "en", kind) for g, kind in enumerate(("repeat", "symbol", "line")) for i in range(400)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: i % 400 % 100 >= junk for i in range(1200)}


def test_sketches_merge(spark, docs):
    rows = quality.measures(docs.select("doc_id", "text", "lang", "source")).select("lang", "source", *[F.col(f"__tsr_{b}").alias(b) for b in quality.BASE])
    whole = quality.sketch(rows)
    parts = quality.sketch(rows.filter("n_words % 2 = 0")).unionByName(quality.sketch(rows.filter("n_words % 2 = 1")))
    assert rows_of(whole) == rows_of(parts.groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n")))


def test_toxicity(spark, docs, sf_dir):
    got = spark.createDataFrame(QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").collect())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    right = [r for r in held if r.predicted == r.toxic]
    assert len(right) >= 0.9 * len(held) and sum(r.toxic for r in held) >= 3
    assert got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    odd = toxicity.toxicity(docs, spark.createDataFrame([(1, 1, "x"), (4, None, "x"), (None, 1, "x"), (7, 0, "y"), (7, 1, "y")], "doc_id long, toxic int, score string"))
    assert odd.count() == docs.count()
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_isotonic():
    score = np.array([0.1, 0.2, 0.2, 0.3, 0.9])
    steps, values = toxicity.isotonic(score, np.array([0.0, 1, 0, 0, 1]))
    assert list(steps) == sorted(steps) and list(values) == sorted(values)
    steps, values = toxicity.isotonic(np.arange(101.0), np.array([0.0, 1, *[0] * 99]))
    assert (np.diff(values) >= 0).all()
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 60)
        y = np.array([float(r.random() < 0.3) for _ in range(n)])
        steps, values = toxicity.isotonic(np.array([float(r.randint(0, 20)) for _ in range(n)]), y)
        assert (np.diff(steps) > 0).all() and (np.diff(values) >= 0).all() and values.min() > 0 and values.max() < 1


def plain_isotonic(y, w):
    """Monotone least squares by its minimax formula."""
    mean = lambda i, j: sum(a * b for a, b in zip(y[i : j + 1], w[i : j + 1])) / sum(w[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]


def test_pooling_is_the_monotone_least_squares_fit():
    r = random.Random(6)
    for _ in range(100):
        y, w = [r.random() for _ in range(12)], [r.randint(1, 5) for _ in range(12)]
        sizes = toxicity._pool(y, w)
        at = np.cumsum([0, *sizes])
        got = [sum(a * b for a, b in zip(y[i:j], w[i:j])) / sum(w[i:j]) for i, j in zip(at, at[1:]) for _ in range(j - i)]
        assert np.allclose(got, plain_isotonic(y, w))


def test_trees_score_as_a_plain_walk():
    r = np.random.Generator(np.random.PCG64(2))
    x = r.normal(size=(400, len(toxicity.FEATURES)))
    y = ((x[:, 0] > 0.5) | (x[:, 3] * x[:, 4] > 1)).astype(float)
    trees = toxicity.Trees().fit(x, y)
    got = trees.score(x[:50])
    for row, have in zip(x[:50], got, strict=True):
        want = trees.base
        for feature, edge, value in trees.trees:
            node = 0
            for depth in range(toxicity.DEPTH):
                k = 2**depth - 1 + node
                node = 2 * node + int(feature[k] >= 0 and row[feature[k]] > edge[k])
            want += value[node]
        assert abs(want - have) < 1e-9
    assert ((trees.score(x) > 0) == (y > 0)).mean() > 0.95


def test_training_rows_are_of_documents(spark):
    docs = spark.createDataFrame([(i, f"t{k}") for i in range(40) for k in range(2)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, 20).collect()
    assert len(got) == 20 and {r.text for r in got} == {"t0"} and all(r.id < 40 and zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_language(spark, docs):
    got = spark.createDataFrame(QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect())
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    held = got.join(truth, "doc_id").filter("held_out and length(text) > 40 and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    rows = [(r["text"], r["lang_pred"], r["score"]) for r in got.join(truth, "doc_id").collect()]
    assert all(0 <= s <= 1 for _, _, s in rows)
    odd = {r.doc_id: r for r in language.languages(docs).collect()}
    assert all((odd[i].lang_pred == "und") == (not any(map(str.isalpha, t or ""))) for i, t in corpus() if i is not None)
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(docs.limit(0)).count() == 0


def test_profiles_are_bundles_of_bound_grams():
    got = language.Bundler().profiles(["ab!", "", None])
    v = {c: language.letter_vector(ord(c) if c else 0) for c in ("a", "b", "")}
    bind = lambda x, y, z: np.roll(v[x], 2) * np.roll(v[y], 1) * v[z]
    assert np.array_equal(got[0], bind("", "a", "b") + bind("a", "b", "")) and not got[1:].any()


def plain_language(texts, train):
    """Best language and cosine of texts, by letter vectors bound, bundled and compared one by one."""
    def profile(text):
        low = "".join(c if c.isalpha() else "\0" for c in f" {text.lower()} ")
        while "\0\0" in low:
            low = low.replace("\0\0", "\0")
        out = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(low, low[1:], low[2:]):
            if b != "\0" or (a != "\0" and c != "\0"):
                v = [language.letter_vector(ord(x)) for x in (a, b, c)]
                out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        n = np.linalg.norm(out)
        return out / n if n else out
    protos = {}
    for lang, text in train:
        protos[lang] = protos.get(lang, 0) + profile(text)
    protos = {k: v / np.linalg.norm(v) for k, v in sorted(protos.items())}
    return [max(((float(profile(t) @ v), k) for k, v in protos.items()), key=lambda x: (x[0], x[1])) for t in texts]


def test_languages_as_plain_cosines(spark):
    train = [("x", "hello there my friend"), ("y", "guten tag mein freund"), ("x", "the other one"), ("y", "der andere weg")]
    rows = [(i, *r) for i, r in zip([k for k in range(99) if zlib.crc32(str(k).encode()) % 4 != 2], train)]
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2][:4]
    texts = ["there is my other hello", "mein andere freund", "the weg", "der der tag"]
    docs = spark.createDataFrame(rows + [(k, "x", t) for k, t in zip(held, texts, strict=True)], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    for k, (cosine, lang) in zip(held, plain_language(texts, train), strict=True):
        assert got[k].lang_pred == lang and abs(got[k].score - max(0, cosine)) < 1e-4


def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = token_files.token_digest(docs, path, sequence=64).collect()
    ids = [(i, own.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in corpus()]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for i, x in ids if i is not None)
    total = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == total
        total += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert token_files.token_digest(empty, path).count() == 0


def test_sequences_are_read_alone(spark, docs):
    from tessera.llm.common import scratch

    path = public_tokenizers.path("word_bpe_49k.json")
    part = token_files.write_tokens(docs, path, scratch(spark, "t"), sequence=32).collect()[0]
    reader = token_files.open_file(part["tokens"])
    flat = np.concatenate([reader.get_batch(k).column(0).flatten().to_numpy() for k in range(reader.num_record_batches)])
    ids, mask = token_files.read_sequence(part["tokens"], 3)
    assert len(ids) == len(mask) == 32 and np.array_equal(ids, flat[96:128]) and mask.all()
    assert not ids.flags.owndata and not mask.flags.owndata and ids.dtype == np.uint16
    last, mask = token_files.read_sequence(part["tokens"], -(-part["n_tokens"] // 32) - 1)
    used = (part["n_tokens"] - 1) % 32 + 1
    assert mask.tolist() == [1] * used + [0] * (32 - used) and last[used - 1] == token_files.END_ID and not last[used:].any()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_vocabulary_file(spark, docs, name):
    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_digest(docs, path, sequence=128).collect() if r.doc_id is not None)
    ids = [(i, own.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in corpus() if i is not None]
    assert got == sorted((i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for i, x in ids)


def test_encoder_of_random_strings():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder, r = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(3)
    texts = ["".join(r.choice("abÀé́İ '\n\t 1日 !<|> 　sll.,\x1c") for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|>a b<|startoftext|>"]
    assert encoder.encode(texts) == [np.asarray(e.ids, "<u2").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]


def test_encoder_holds_no_more_with_more_words():
    import tracemalloc

    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    letters = str.maketrans("0123456789", "abcdefghij")
    slices = [[" ".join(str(k).translate(letters) for k in range(i, i + 20_000))] for i in range(0, 400_000, 20_000)] + [[f"{'xy' * 50_000} {i}{'-' * 50_000}"] for i in range(20)]
    held = []
    tracemalloc.start()
    for texts in slices:
        encoder.encode(texts)
        held.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert max(held) < 60 << 20 and held[-1] - held[-20] < 1 << 20
    for texts in (slices[0], slices[12], slices[-1]):
        assert encoder.encode(texts) == [np.asarray(e.ids, "<u2").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]


def test_encoder_cuts_long_texts(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    monkeypatch.setattr(token_files, "SLICE", 9)
    monkeypatch.setattr(token_files, "CACHE", 20)
    texts = [t or "" for _, t in corpus()] + ["a  b   ", " " * 30, "x" * 30, "x" * 9 + " ", "<|endoftext|> <|endoftext|>"]
    assert encoder.encode(texts) == [np.asarray(e.ids, "<u2").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [list(token_files.stretches(t, 3)) for t in ("", "abc d", "abcd", "a b c d ", "    ")] == [[""], ["abc", "d"], ["abcd"], ["a b", "c d", ""], ["   ", ""]]


def test_encoder_remembers_words_however_pieces_write_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    words = [a + b + c for a in ("ba", "do", "ké") for b in ("ri", "lu", "ßa") for c in ("n", "mo", "ti")]
    shapes = ["{}", "{},", "{}.", "({})", '"{}"', "{}'s", "{}\nand", "-{}-", "{}/{}"]
    texts = [" ".join(s.format(w, w) for s in shapes for w in (word, word.title(), word.upper())) for word in words]
    assert encoder.encode(texts) == [np.asarray(e.ids, "<u2").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.known.ids) < 2 * len(words)


def test_encoder_cuts_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder, r = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(5)
    letters = [c for c in map(chr, range(0x260)) if c.isprintable()]
    texts = [f"a{c}! {c}{c}1{c} '{c} {c}'s" for c in letters] + ["".join(r.choice("'srevldtmS1² \nxé!-") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["", "'", "'s", "'re", "x'll'd", "''s", "\0", "\0 a \0", "a <| b", "日本 a's 日本", "\n", " "]
    ids = [np.asarray(e.ids, "<u2").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == ids
    assert [encoder.encode([t])[0] for t in texts[-400:]] == ids[-400:] and encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]
