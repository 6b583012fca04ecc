"""Removal of repeated word windows against plain Python."""

import random

import pytest

from tessera.llm import phrases
from tests.llm import brute


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, shard string").repartition(3)
    return sorted(map(tuple, phrases.remove_repeated_words(docs, **how).collect()), key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "日本", " ", "a b", "\x1c", "A", "a"]
    blanks = [" ", "  ", "\t", "\n", "\r\n", "\x0b"]
    line = [rng.choice(words) for _ in range(16)]
    texts: list = [None, "", " \n", "one", " ".join(line), " ".join(line[:12]), "a " * 300, "a " * 13, "a b " * 90]
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if texts and rng.random() < 0.5:
            old = brute.words(rng.choice(texts))
            a = rng.randrange(len(old) + 1)
            w += [x.decode() for x in old[a : a + rng.randrange(40)]]
        if rng.random() < 0.6:
            w += line
        texts.append("".join(x + rng.choice(blanks) for x in w + [rng.choice(words) for _ in range(8)]))
    ids = rng.sample(range(-50, 500), len(texts))
    rows = list(zip(ids, texts))
    return [*rows, rows[12], (rows[13][0], rows[14][1]), (None, rows[15][1]), (None, rows[15][1])]


@pytest.mark.parametrize("in_task", [1, 5, 1000])
def test_windows(spark, in_task):
    rows = corpus()
    assert found(spark, rows, in_task=in_task) == brute.window_removals(rows)


def test_stretches_and_many_automata(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(phrases, "STRETCH", 50)
    monkeypatch.setattr(phrases, "COMPILED", 200)
    monkeypatch.setattr(phrases, "HELD", 3)
    assert found(spark, rows) == brute.window_removals(rows)


def test_long_text_and_common_line(spark):
    rng = random.Random(4)
    line = " ".join(f"c{i}" for i in range(15))
    rows = [(i, f"{rng.random()} {rng.random()} {line} {rng.random()} {rng.random()}") for i in range(1500)]
    rows.append((5000, " ".join(str(rng.randrange(3)) for _ in range(60_000))))
    rows.append((5001, rows[-1][1][1000:90_000]))
    assert found(spark, rows) == brute.window_removals(rows)


def test_texts_and_empty_table(spark):
    rows = [(1, " ".join("abcdefghijklmno")), (2, "x " + " ".join("abcdefghijklmno") + "\ty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: bytes(r["kept_text"]) for r in phrases.remove_repeated_words(docs, texts=True).collect()}
    assert out == {1: rows[0][1].encode(), 2: b"x y"}
    assert phrases.remove_repeated_words(docs.limit(0)).count() == 0
    assert phrases.remove_repeated_words(docs.filter("doc_id = 1").withColumn("text", docs["text"].substr(1, 3))).count() == 1


def test_automaton_confirms_words():
    a, b = [" ".join(f"{x}{i}" for i in range(14)).encode() for x in "pq"]
    rows = [(1, 1, a), (2, 2, a), (3, 4, b), (5, 5, a[: a.rindex(b" ")])]
    assert sorted(phrases.locate(rows)) == [(0, 0, 2, 1), (1, 0, 2, 1), (2, 0, 2, 3), (3, 0, 1, 1)]
    assert list(phrases.locate([(1, 1, a), (1, 1, a)])) == []
