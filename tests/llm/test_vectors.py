"""Codes and hard negatives against plain Python, with ties, repeats, nulls, empty tables and clashing names."""

import random

import numpy as np
import pytest

from tessera.llm import codes, negatives
from tessera.llm.codes import Moves, follow, scan
from tests.llm import brute

SCHEMA = "vec_id long, label int, embedding array<float>"


def rows(n=260, d=32, seed=1, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(4)]
    out = [(i, rng.choice([None, 0, 1, 2, 9]), [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]
    odd = {7: None, 11: [None] * d, 13: [float("nan")] * d, 17: [float("inf")] + [0.0] * (d - 1), 19: [0.5] * (d - 1)}
    return [(i, lab, odd.get(i, v)) for i, lab, v in out]


def small(n=260, d=32, seed=2):
    """Components with few values, so that distances and scores tie."""
    rng = random.Random(seed)
    return [(i, rng.choice([None, 0, 1]), [rng.choice([-1, 0, 0, 1]) / 256 for _ in range(d)]) for i in range(n)]


def one_dimension(given, d=32):
    return [r for r in given if r[2] is None or len(r[2]) == d]


@pytest.mark.parametrize("given", [rows(), small(), rows(30), rows(3, seed=5), small(90)[:70] * 2])
def test_codes(spark, given):
    clashing = spark.createDataFrame([(*r, 1, 2, 3) for r in given], f"{SCHEMA}, whole int, error int, __tsr_salt int").repartition(3)
    assert sorted(map(tuple, codes.compress(clashing).collect()), key=str) == brute.codes(one_dimension(given))


def test_codes_of_repeated_and_missing_ids(spark):
    given = small(40) + [(3, 1, [1.0] * 32), (None, None, [0.25] * 32), (None, 2, [0.25] * 32)]
    assert sorted(map(tuple, codes.compress(spark.createDataFrame(given, SCHEMA)).collect()), key=str) == brute.codes(given)
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.compress(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(empty).count() == codes.compress(spark.createDataFrame([(None, 1, [1.0])], SCHEMA)).count() == 0


def test_codes_of_large_components_and_odd_dimensions(spark):
    given = [(i, i % 2, [3e38 * (i % 3 - 1), 1.0 * i, -2.0]) for i in range(9)]
    found = codes.compress(spark.createDataFrame(given, SCHEMA)).collect()
    assert len(found) == 9 and all(r["error"] == 0 for r in found)


def test_bounds_prove_what_they_skip():
    rng = np.random.default_rng(3)
    x, book = rng.integers(-90, 90, (4000, 4)), rng.integers(-90, 90, (64, 4))
    entry, upper, lower = scan(x, book)
    scanned = []
    for _ in range(4):
        new = book + rng.integers(-2, 3, book.shape)
        entry, upper, lower, n = follow(x, new, Moves(book, new), entry, upper, lower)
        book = new
        scanned.append(n)
        exact = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (entry == exact.argmin(1)).all()
        assert (upper**2 >= exact.min(1)).all()
    assert max(scanned) < 4000


@pytest.mark.parametrize("given", [rows(420), small(420), rows(120, spread=0.02), small(1), rows(210, d=1, seed=4), rows(101)[:101:100]])
def test_negatives(spark, given):
    clashing = spark.createDataFrame([(*r, 1, 2) for r in given], f"{SCHEMA}, slot int, scores int").repartition(3)
    d = max((len(r[2]) for r in given if r[2]), default=0)
    assert sorted(map(tuple, negatives.hard_negatives(clashing).collect())) == brute.negatives(one_dimension(given, d))


def test_negatives_in_many_blocks_and_shards(spark, monkeypatch):
    given = rows(900, seed=8)
    monkeypatch.setattr(negatives, "BLOCK", 2)
    monkeypatch.setattr(negatives, "SHARD", 100)
    assert sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(given, SCHEMA)).collect())) == brute.negatives(one_dimension(given))


def test_negatives_of_repeated_ids_and_empty_tables(spark):
    given = small(150)
    twice = [*given, *given[:120], (None, 1, [0.5] * 32)]
    assert sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(twice, SCHEMA)).collect())) == brute.negatives(given)
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, None, [1.0]), (100, 1, None)], SCHEMA)).count() == 0
