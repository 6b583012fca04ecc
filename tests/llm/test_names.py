"""Callers' columns that are named like an operator's own, and texts that are hard for its loops."""

import random
import time

from tessera.llm import decontaminate, mixing


def test_mix_keeps_columns_of_any_name(spark):
    own = ["__tsr_id", "__tsr_taken", "__tsr_n", "__tsr_part", "__tsr_k", "__tsr_t", "__tsr_size", "__tsr_source", "c0", "c3"]
    rows = [(i, f"w{i} x y", "ab"[i % 2], *[100 * i + k for k in range(len(own))]) for i in range(12)] + [(50, None, "a", *[7] * len(own)), (51, "", None, *[7] * len(own))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{c} long' for c in own)}")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert got and all([r[c] for c in own] == [100 * r["doc_id"] + k for k in range(len(own))] for r in got)
    plain = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((r["doc_id"], r["text"]) for r in plain)
    assert mixing.mix(docs.limit(0)).count() == 0


def overlap_by_steps(item, words, shift):
    """The stretch that a walk along the diagonal finds, starting anew where its score falls to 0."""
    a, b = max(0, -shift), min(len(item), len(words) - shift)
    best, score, first, at, hits = (0, a, a), 0, a, 0, 0
    for k in range(a, b):
        if score == 0:
            first, hits = k, 0
        same = bool(item[k] == words[k + shift])
        score, hits = score + (1 if same else -decontaminate.MISMATCH), hits + same
        if score <= 0:
            score = 0
        elif score > at:
            at, best = score, (hits, first, k + 1)
    return best


def test_overlaps_along_a_diagonal():
    r, fold = random.Random(3), decontaminate.Words()
    for _ in range(300):
        item, words = fold.hashes([" ".join(r.choice("ab") for _ in range(r.randrange(1, 20))), " ".join(r.choice("ab") for _ in range(r.randrange(1, 30)))])
        shift = r.randrange(-len(item) + 1, len(words))
        assert decontaminate.overlap(item, words, shift) == overlap_by_steps(item, words, shift)


def test_long_runs_of_one_word_take_seconds(spark):
    items = ["a " * 8 + " ".join(f"k{i}" for i in range(13)), "b " * 300]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, "b " * 30_000), (3, "c " * 100_000 + items[0])], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert found == {1: [], 2: [1], 3: [0]} and time.time() - began < 60


def test_scratch_goes_after_the_session_was_stopped(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from tessera.llm.common import keep
for k in range(2):
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
    assert keep(spark.range(3), "x").count() == 3
    spark.stop()
import os
print(len([n for n in os.listdir("{tmp_path}") if n.startswith("tessera-")]))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("2"), done.stderr[-500:]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("tessera-")]
