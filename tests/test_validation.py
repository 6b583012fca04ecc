import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import checks as C
from tessera.operators import tools as T
from tessera.plans import validation
from tessera.streaming import episodes as S

NAMES = [n for n, f in __spark_entry__.queries().items() if f.__module__ == validation.__name__] + ["stream_episode_state", "stream_sessions", "stream_with_step"]


def close(row):
    return repr(tuple(round(x, 5) if isinstance(x, float) else x for x in row))


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in ("events", "conversations", "documents", "benchmark", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, con, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(close(r[c] for c in cols) for r in got.collect()) == sorted(map(close, want.fetchall()))


def test_every_probe_and_error_occurs(spark, sf_dir):
    q = __spark_entry__.queries()
    fired = {p for r in q["eval_probes_by_group"](spark, sf_dir).collect() for p in r.probes.split("; ") if p}
    assert fired == {"JUDGE-GAMING", "MEMORY-GUESSING", "TOOL-AVOIDANCE", "FABRICATION", "LENGTH-INFLATION"}
    errors = {r.error for r in q["tool_execute"](spark, sf_dir).collect()}
    assert errors == {None, "unknown_tool", "missing_arg", "unexpected_arg", "tool_error", "internal_error"}


def test_execute_odd_calls(spark):
    passages = spark.createDataFrame([(1, 0, "Moon", "blue moon"), (1, 1, "Sun", None), (2, 0, "Moon", "red")], "task_id long, pos int, title string, text string")
    rows = [(1, 1, None, None), (2, 1, "search", {"query": "moon", "k": "1"}), (3, 1, "search", {"query": "moon red", "k": "9"}), (4, 2, "read", {"title": "moon "}), (5, 1, "read", {"title": "Sun"}), (6, 3, "read", {"title": "Sun"}), (7, 1, "answer", {"text": " x [Moon] "})]
    got = {r.id: r for r in T.execute(spark.createDataFrame(rows, "id int, task_id long, name string, args map<string,string>"), passages).collect()}
    assert len(got) == 7 and got[1].error == "unknown_tool" and got[2].titles == ["Moon"] and got[3].titles == ["Moon"] and got[4].obs == "[Moon]\nred"
    assert got[5].obs == "[Sun]\n" and got[6].error == "tool_error" and got[7].obs == "x [Moon]" and got[7].ok
    assert T.execute(spark.createDataFrame(rows[:0], "id int, task_id long, name string, args map<string,string>"), passages).count() == 0


def test_backends():
    for backend in ("nli", "embedding"):
        with pytest.raises(NotImplementedError):
            C.align(F.lit("a"), F.lit("b"), backend)
    with pytest.raises(ValueError):
        C.align(F.lit("a"), F.lit("b"), "guess")
    with pytest.raises(ValueError):
        C.require_trainable("test")
    C.require_trainable("train")


def test_watcher_pushes_once(spark, tmp_path):
    source, seen = f"{tmp_path}/steps", []
    for k, steps in enumerate(([3, 5], [4], [9])):
        spark.createDataFrame([(s,) for s in steps], "step long").coalesce(1).write.mode("append").parquet(source)
        # each turn is a restart from the folder
        S.watch_steps(spark.readStream.schema("step long").parquet(source), seen.append, f"{tmp_path}/w").awaitTermination()
    assert seen == [5, 9]
