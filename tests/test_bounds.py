"""Odd arguments, and plans that keep no table in one task."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import tools as T


def test_arguments_without_a_value(spark):
    none = [(1, 0, "answer", {"text": None}), (2, 0, "read", {"title": None}), (3, 0, "search", {"query": "body", "k": None}), (4, 0, "search", {"query": None}), (5, 0, "read", None), (6, 0, None, None), (7, 0, "search", {"query": "body", "k": "1"})]
    calls = spark.createDataFrame(none, "id int, task_id int, name string, args map<string,string>")
    passages = spark.createDataFrame([(0, 0, "T", "body one"), (0, 1, "U", "none body")], "task_id int, pos int, title string, text string")
    got = {r["id"]: (r["ok"], r["error"], r["obs"]) for r in T.execute(calls, passages).collect()}
    assert got[1] == (True, None, "None")
    assert got[2] == (False, "tool_error", "error: read: no passage titled 'None'.")
    assert got[3][:2] == (False, "internal_error")
    assert got[4][0] and got[4][2].startswith("search results:\n[1] U: ")
    assert got[5] == (False, "missing_arg", "error: read missing required arg(s): title")
    assert got[6] == (False, "unknown_tool", "error: unknown tool ''") and got[7][0]
    assert all(obs is not None for _, _, obs in got.values())


def test_menus_of_a_column(spark):
    rows = spark.createDataFrame([(["read", "fly", "search"],), ([],), (None,), ([None, "answer"],)], "names array<string>")
    got = [r[0] for r in rows.select(T.menu_of(F.col("names"))).collect()]
    assert got == [T.menu(["read", "search"]), "", None, T.menu(["answer"])]


# ---- order statistics and intervals


@pytest.mark.parametrize("values", [[5], [3, 1, 2], [7] * 400 + list(range(300)), [None, 2.5, None, -1.0, 9.0], [0.1 * (i * 37 % 1000) for i in range(3000)], [], [None]])
def test_index_quantiles_without_a_sort(spark, values):
    from tessera.operators.selection import index_quantile

    qs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    kept = sorted(v for v in values if v is not None)
    want = [(q, float(kept[min(int(len(kept) * q), len(kept) - 1)])) for q in qs] if kept else []
    rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(3)
    assert sorted(map(tuple, index_quantile(rows, "x", qs, fan=4, few=5).collect())) == want


def test_quantiles_of_all_groups_at_once(spark):
    from tessera.operators.selection import index_quantiles_by

    of = {"a": [float(i * 37 % 1000) for i in range(800)], "b": [7.0] * 50 + [1.0, 9.0], None: [5.0], "c": [None]}
    rows = spark.createDataFrame([(g, v) for g, vs in of.items() for v in vs], "g string, x double").repartition(3)
    want = {(g, q, sorted(vs)[min(int(len(vs) * q), len(vs) - 1)]) for g, vs in of.items() if g != "c" for q in (0.0, 0.5, 0.9, 1.0)}
    assert set(map(tuple, index_quantiles_by(rows, "g", "x", [0.0, 0.5, 0.9, 1.0], fan=4, few=5).collect())) == want
    assert index_quantiles_by(rows.limit(0), "g", "x", [0.5]).count() == 0


def plain_bootstrap(pairs, draws, low, high):
    import hashlib

    from tessera.operators.selection import POISSON

    means = []
    for b in range(draws):
        w = []
        for key, _ in pairs:
            word = hashlib.md5(f"{b // 4}:{key}".encode()).hexdigest()[8 * (b % 4) : 8 * (b % 4) + 8]
            w.append(sum(int(word, 16) / 2**32 >= p for p in POISSON))
        if sum(w):
            means.append(round(sum(x * d for x, (_, d) in zip(w, pairs)) / sum(w), 6))
    means.sort()
    return means[min(int(draws * low), len(means) - 1)], means[min(int(draws * high), len(means) - 1)]


def test_bootstrap_is_that_of_its_generator(spark):
    from tessera.operators.selection import POISSON, poisson_bootstrap

    rng = random.Random(2)
    pairs = [(f"q-{k}", float(rng.choice([-1, 0, 0, 1, 1]))) for k in range(60)]
    found = poisson_bootstrap(spark.createDataFrame([*pairs, ("null", None)], "key string, d double").repartition(4), 40).first()
    assert (found["n"], found["delta"]) == (60, round(sum(d for _, d in pairs) / 60, 6))
    assert (found["low"], found["high"]) == plain_bootstrap(pairs, 40, 0.025, 0.975)
    assert found["low"] <= found["delta"] <= found["high"]
    none = poisson_bootstrap(spark.createDataFrame([], "key string, d double"), 8).first()
    assert none["n"] == 0 and none["delta"] is None and none["low"] is None
    from math import exp, factorial

    for k, p in enumerate(POISSON[:-1]):
        assert abs(p - sum(exp(-1) / factorial(i) for i in range(k + 1))) < 1e-9


def test_quantile_and_bootstrap_plans_have_no_single_task(spark, capsys):
    from tessera.operators.selection import poisson_bootstrap

    plan = poisson_bootstrap(spark.range(1000).selectExpr("id AS key", "cast(id AS double) AS d"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan


# ---- splits


def test_faults_of_splits_are_named(spark):
    from tessera.operators import splits

    row = "id int, split string, place int"
    was = [(i, "a" if i < 10 else "b", i) for i in range(20)]
    frozen = spark.createDataFrame(was, row)
    good = splits.validate(frozen, {"a": 10, "b": 10}, frozen)
    assert good.filter("ok").count() == good.count() == 2
    splits.require(good)
    short = splits.validate(frozen.filter("id <> 3"), {"a": 10, "b": 10})
    assert [(r["splits"], r["n"]) for r in short.filter("not ok").collect()] == [("a", 9)]
    now = [r for r in was if r[0] != 3] + [(4, "b", 99), (None, "a", 3), (5, "a", 5), (7, "c", 0)]
    report = splits.validate(spark.createDataFrame(now, row), {"a": 10, "b": 10, "d": 1}, frozen)
    got = {(r["check"], r["splits"]): (r["n"], r["expected"], r["example"]) for r in report.filter("not ok").collect()}
    assert got == {("size", "a"): (9, 10, None), ("size", "b"): (11, 10, None), ("size", "c"): (1, None, None), ("size", "d"): (0, 1, None), ("leak", "a/b"): (1, None, 4), ("leak", "a/c"): (1, None, 7), ("moved", "a"): (1, None, 3)}
    with pytest.raises(ValueError, match="leak a/b: 1, such as 4; leak a/c.*moved a: 1, such as 3; size a: 9 of 10"):
        splits.require(report)
    swapped = [(i, s, {5: 6, 6: 5}.get(p, p)) for i, s, p in was]
    assert [(r["check"], r["n"]) for r in splits.validate(spark.createDataFrame(swapped, row), {"a": 10, "b": 10}, frozen).filter("not ok").collect()] == [("moved", 2)]
    assert splits.validate(frozen.limit(0), {"a": 1}).collect()[0]["n"] == 0


def test_fraction_is_rounded_as_sql_rounds(spark, tmp_path):
    import duckdb

    from tessera.plans.catalogue import ORACLES
    from tessera.plans.validation import split_fraction

    for k, ids in enumerate([range(1), [None], range(29), range(30), range(31), range(50), [*range(49), None], range(2571)]):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"{d}/documents.parquet")
        c = duckdb.connect()
        c.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
        want = sorted(c.execute(ORACLES["split_fraction"]).fetchall(), key=str)
        assert sorted(map(tuple, split_fraction(spark, d).collect()), key=str) == want, len(ids)


# ---- evaluations


def test_arms_are_written_and_summarised_by_one_scan(spark, sf_dir, tmp_path):
    from tessera.plans.catalogue import _rows
    from tessera.sources import evaluation as V

    rows, folder = _rows(spark, sf_dir).drop("steps").persist(), f"file://{tmp_path}/e"
    base = V.write_arms(rows.filter("arm = 'base'"), folder, ["base"])
    held = V.write_arms(rows.filter("arm = 'tuned'"), folder, ["tuned", "never"], {"k": 1})
    assert base["base"]["n"] + held["tuned"]["n"] == rows.count() == spark.read.parquet(f"{folder}/rows").count()
    assert held["never"]["n"] == 0 and held["never"]["correct_rate"] is None
    want = {r["arm"]: {k: v for k, v in r.asDict().items() if k != "arm"} for r in V.summarize(rows, "arm").collect()}
    assert V.read_arms(spark, folder) == want == {"base": base["base"], "tuned": held["tuned"]}
    # an arm that is written again replaces its own part alone
    again = V.write_arms(rows.filter("arm = 'tuned'").limit(5), folder, ["tuned"])
    assert spark.read.parquet(f"{folder}/rows").filter("arm = 'base'").count() == base["base"]["n"] and again["tuned"]["n"] == 5
    assert V.read_arms(spark, folder)["base"] == base["base"] and V.read_arms(spark, folder)["tuned"]["n"] == 5
    with pytest.raises(Exception, match="no such arm: tuned"):
        V.write_arms(rows, folder, ["base"])
    lines = V.card({"base": base["base"], "tuned": held["tuned"]}, "x", "m", {"seed": 1})
    assert lines[:5] == ["---", "base_model: m", "seed: 1", "---", "# x"] and f"| correct (exact match) | {base['base']['correct_rate']:.3f} | {held['tuned']['correct_rate']:.3f} |" in lines
    assert any(line.startswith("tuned: wrong_answer ") and line.endswith(" at the cap of 8 calls.") for line in lines)
    rows.unpersist()
