import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import native as N
from tessera.operators import prompts as P
from tessera.plans.views import table

TABLES = ("events", "conversations", "documents", "benchmark")
NAMES = ["native_fold", "native_episodes", "native_causes", "bracket_causes", "prefix_breaks", "opening_prompts", "rebuild_first_turn", "prompt_sentinels", "rederive_observations"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def replies(spark, texts):
    df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "ep int, t int, text string")
    return df, spark.createDataFrame([(1, i + 1, f"obs {i}", i != 1, ["T"]) for i in range(len(texts))], "ep int, t int, obs string, ok boolean, titles array<string>")


CALLED = '<tool_call>{"name": "read", "arguments": {"title": "T"}}</tool_call>'


def test_native_fold(spark):
    texts = ["hm " + CALLED, CALLED, None, '<tool_call>{"name": "fly"}</tool_call>', " done [T] ", CALLED]
    rows = N.fold_native(*replies(spark, texts)).orderBy("t").collect()
    assert [(r.kind, r.error, r.obs) for r in rows] == [("call", None, "obs 0"), ("call", "tool_error", "obs 1"), ("empty", "empty", None), ("parse", "parse", None), ("plain_text", None, "done [T]")]
    assert rows[0].thought == "hm" and rows[0].titles == ["T"] and rows[1].titles == []
    strict = N.fold_native(*replies(spark, texts), strict=True).orderBy("t").collect()
    assert [r.kind for r in strict] == ["call", "call", "parse", "parse", "parse", "call"]
    eps = N.native_episodes(N.fold_native(*replies(spark, [CALLED] * 12)), spark.createDataFrame([(1,), (2,)], "ep int")).orderBy("ep").collect()
    assert [(r.finish_mode, r.n_steps) for r in eps] == [("round_limit", 9), ("dead", 0)]


def test_native_cause(spark):
    cases = [(CALLED, "stop", None, "parsed_ok"), ("<tool_call>{x}</tool_call>", "stop", None, "malformed_json_in_tool_call"), ("<tool_call>{", "length", None, "tool_call_truncated_by_length"), ("<tool_call>{", "stop", "<x>", "tool_call_unclosed(stop='<x>')"), ("so", "length", None, "prose_truncated_by_length"), (None, None, None, "plain_prose_no_tool_call")]
    df = spark.createDataFrame(cases, "text string, f string, s string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", N.native_cause(F.col("text"), F.col("f"), F.col("s"))).collect())


def test_prefix(spark):
    cases = [([1, 2], [1, 2, 3], 2), ([1, 9], [1, 2, 3], 1), ([], [1], 0), (None, [1], 0), ([4], [5], 0)]
    df = spark.createDataFrame(cases, "a array<int>, b array<int>, want int")
    assert all(r.got == r.want for r in df.withColumn("got", N.common_prefix(F.col("a"), F.col("b"))).collect())
    steps = spark.createDataFrame([(1, 1, [1], [2]), (1, 2, [1, 2, 3], [4]), (1, 3, [1, 2], [5]), (1, 4, None, None)], "ep int, t int, prompt array<int>, completion array<int>")
    assert [tuple(r) for r in N.prefix_breaks(steps).orderBy("t").collect()] == [(1, 3, 4, 2, 2), (1, 4, 3, 0, 0)]


def test_rederive_searches(spark):
    passages = spark.createDataFrame([(1, 0, "Moon", "a blue moon"), (1, 1, "Sun", "a red sun"), (1, 2, "Moon", "the last moon")], "task_id int, pos int, title string, text string")
    turns = [("Action: search[moon]", "search results:\n[1] Moon: the last moon"), ("Action: search[moon]", "made up"), ("Action: search[zzz]", "no results."), ("Action: read[sun]", "[Sun]\na red sun"), ("Action: read[Star]", "error: read: no passage titled 'Star'. Try again."), ("Action: answer[x]", "-"), ("well, Action: read[Sun]", "-")]
    rows = [(i, 1 if i < 7 else 2, j, role, text) for i, pair in enumerate([*turns, turns[0]]) for j, (role, text) in enumerate(zip(("assistant", "user"), pair, strict=True))]
    got = {r.conv_id: r.finding for r in P.rederive(spark.createDataFrame(rows, "conv_id int, task_id int, turn int, role string, text string"), passages).collect()}
    assert got == {0: None, 1: "observation_not_reproducible", 2: None, 3: None, 4: None, 6: "action_not_at_line_start", 7: "task_not_found_in_pool"}


def test_empty(spark, sf_dir):
    none = table(spark, sf_dir, "conversations").limit(0)
    assert P.rebuild_first(none, none.selectExpr("conv_id", "text AS prompt")).count() == 0
