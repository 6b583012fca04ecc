"""Streams over restarts, late and repeated rows, against plain Python and against the same work on a table."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import rewards as W
from tessera.streaming import episodes as S
from tessera.streaming import machine as M
from tessera.streaming import sinks
from tessera.streaming import steps as T

BEGIN = datetime(2024, 1, 1)
KINDS = ["view", "click", "purchase", "view", "view"]


def events(n=900, users=12, seed=1):
    """Rows of the table events, in order of their times, some at equal times."""
    rng = random.Random(seed)
    at, out = BEGIN, []
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 30, 45]))
        out.append((i, at, rng.randrange(users) if i % 50 else None, rng.choice(KINDS), 1.0, "{}"))
    return out


def deliver(spark, rows, folder, name):
    spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events-{name}")
    return f"{folder}/events-*"


def stream(spark, folder):
    return spark.readStream.schema(S.EVENTS).option("recursiveFileLookup", True).parquet(folder)


def plain(rows, cap=4, idle=timedelta(hours=5), late=timedelta(hours=1)):
    mark = max(r[1] for r in rows) - late
    by = {}
    for i, at, user, kind, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if user is not None and at < mark:
            by.setdefault(user, []).append((at, kind == "purchase"))
    out = []
    for user, turns in by.items():
        own = []
        for at, terminal in turns:
            if own and at > own[-1] + idle:
                out.append((user, own[0], own[-1] + idle, len(own), M.TIMED_OUT))
                own = []
            own.append(at)
            if terminal or len(own) >= cap:
                out.append((user, own[0], at, len(own), M.FINISHED if terminal else M.CAPPED))
                own = []
        if own and own[-1] + idle < mark:
            out.append((user, own[0], own[-1] + idle, len(own), M.TIMED_OUT))
    return sorted(out)


def machine(spark, folder):
    return M.episodes(stream(spark, f"{folder}/in"), "user_id", "ts", "event_id", F.col("event_type") == "purchase", 4, "5 hours")


def drained(spark, folder):
    return sorted(map(tuple, S.drain(machine(spark, folder), "append", f"{folder}/out").collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_episodes_over_restarts(spark, tmp_path, parts):
    rows, folder = events(), f"file://{tmp_path}"
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        random.Random(k).shuffle(part)
        deliver(spark, part, f"{folder}/in", k)
        found = drained(spark, folder)
    assert found == plain(rows)
    assert {r[4] for r in found} == {M.FINISHED, M.CAPPED, M.TIMED_OUT}


def test_turns_that_come_out_of_order_between_batches(spark, tmp_path):
    rows, folder = events(200, 3), f"file://{tmp_path}"
    swapped = rows[:99] + rows[100:101] + rows[99:100] + rows[101:]  # across the border of two batches
    deliver(spark, swapped[:100], f"{folder}/in", 0)
    drained(spark, folder)
    deliver(spark, swapped[100:], f"{folder}/in", 1)
    assert drained(spark, folder) == plain(rows)


def test_state_is_bounded_by_open_episodes(spark, tmp_path):
    rows, folder = events(1500, 40), f"file://{tmp_path}"
    deliver(spark, rows, f"{folder}/in", 0)
    q = sinks.run(machine(spark, folder), lambda batch, k: batch.count(), folder)
    mark = max(r[1] for r in rows) - timedelta(hours=1)
    waiting = sum(r[1] >= mark and r[2] is not None for r in rows)
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 0 < held <= waiting + 4 * 40 < 600


def test_episodes_by_the_processing_clock(spark, tmp_path):
    rows, folder = events(60, 3), f"file://{tmp_path}"
    deliver(spark, rows, f"{folder}/in", 0)
    made = M.episodes(stream(spark, f"{folder}/in"), "user_id", "ts", "event_id", F.col("event_type") == "purchase", 4, "5 hours", clock="processing")
    put = lambda batch, k: batch.write.mode("append").parquet(f"{folder}/rows")
    q = made.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{folder}/q").start()
    try:
        deadline = time.time() + 60
        while not os.path.exists(f"{tmp_path}/rows/_SUCCESS") and time.time() < deadline:
            time.sleep(1)
    finally:
        q.stop()
    found = spark.read.schema(M.EPISODES).parquet(f"{folder}/rows").collect()
    assert found and {r["outcome"] for r in found} <= {M.FINISHED, M.CAPPED}
    assert all(r["n_turns"] <= 4 for r in found)


def test_no_events(spark, tmp_path):
    deliver(spark, events(3)[:0], f"file://{tmp_path}/in", 0)
    assert drained(spark, f"file://{tmp_path}") == []


# ---- resumed logs


def log(spark, folder):
    return sorted(tuple(r)[:4] for r in spark.read.schema(S.EVENTS).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").collect())


def test_a_log_that_is_replayed_adds_nothing(spark, tmp_path):
    rows, folder = events(300), f"file://{tmp_path}"
    for k, part in enumerate((rows[:150], rows[100:], rows)):  # the last one holds every row again, a month later
        deliver(spark, [(i, at + timedelta(days=30 * k), *rest) for i, at, *rest in part], f"{folder}/in", k)
        sinks.run(stream(spark, f"{folder}/in"), sinks.append_new(folder, ["event_id"], ["ts"], "a", buckets=5), f"{folder}/q")
    assert log(spark, folder) == sorted((i, at if i < 150 else at + timedelta(days=30), u, k) for i, at, u, k, *_ in rows)
    sinks.run(stream(spark, f"{folder}/in"), sinks.append_new(folder, ["event_id"], ["ts"], "b", buckets=5), f"{folder}/again")
    assert len(log(spark, folder)) == 300


def test_a_batch_that_runs_twice_adds_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    make = lambda rows: spark.createDataFrame(rows, "a int, b int, v int")
    put = sinks.append_new(folder, ["a", "b"], ["v"], "x", buckets=3)
    read = lambda: sorted(tuple(r) for r in spark.read.schema("a int, b int, v int").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").select("a", "b", "v").na.fill(-1).collect())
    first = make([(1, 1, 9), (1, 1, 3), (None, 2, 5), (None, 2, 4), (2, None, 1)])
    for _ in range(2):
        put(first, 0)
        assert read() == [(-1, 2, 4), (1, 1, 3), (2, -1, 1)]
    second = make([(1, 1, 1), (None, 2, 1), (3, 3, 7)])
    for _ in range(2):
        put(second, 1)
        assert read() == [(-1, 2, 4), (1, 1, 3), (2, -1, 1), (3, 3, 7)]
    put(make([]), 2)
    assert len(read()) == 4


# ---- steps


def test_steps_rise_and_are_those_of_an_as_of_join(spark, tmp_path):
    rng = random.Random(5)
    rows = events(400)
    announced = [(BEGIN + timedelta(minutes=rng.randrange(60, 9000)), rng.randrange(40)) for _ in range(30)]
    steps = T.step_intervals(spark.createDataFrame([*announced, (None, 99), (BEGIN, None)], "ts timestamp, step long"))
    held = sorted(map(tuple, steps.collect()), key=lambda r: r[0])
    assert [s for _, _, s in held] == sorted(s for _, _, s in held) and held[-1][1] is None
    steps.write.parquet(f"{tmp_path}/steps")
    deliver(spark, rows, f"{tmp_path}/in", 0)
    e = stream(spark, f"{tmp_path}/in")
    s = spark.readStream.schema("begin timestamp, end timestamp, step long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/steps")
    found = sorted((r["event_id"], r["step"]) for r in S.drain(T.with_step(e, s, width=7200), "append", f"file://{tmp_path}/out").collect())
    want = [(r[0], max(x for t, x in announced if t <= r[1])) for r in rows if any(t <= r[1] for t, _ in announced)]
    assert found == sorted(want)
    in_time = [s for _, s in sorted(((next(r[1] for r in rows if r[0] == i), i), s) for i, s in found)]
    assert in_time == sorted(in_time)


def test_stretches_suit_the_number_of_steps(spark):
    """However many steps are announced, few of them share a stretch, and few stretches have one."""
    for n in (1, 30, 3000):
        announced = spark.range(n).selectExpr("timestamp_seconds(1704067200 + id * 2592000 div {0}) AS ts".format(n), "id AS step")
        steps = T.step_intervals(announced)
        width = T.stretch(steps)
        held = steps.withColumn("bucket", F.explode(T._buckets(F.col("begin"), T._until(T.HORIZON), width))).groupBy("bucket").count()
        total, most = held.agg(F.sum("count"), F.max("count")).first()
        assert total <= 11 * n + 1 and most <= 12, (n, width)
    assert T.stretch(steps.limit(0)) == 1


def test_a_gate_that_asks_for_the_wrong_thing_does_not_merge_steps(spark):
    infos = spark.createDataFrame([(1, {"outcome": 1.0, "n_citations": 2.0}), (1, {"outcome": 0.0}), (2, {"outcome": 0.5, "judge": None}), (None, {"outcome": 1.0})], "step long, values map<string,double>")
    means = {r["step"]: r for r in T.component_means(infos).collect()}
    assert (means[1]["outcome"], means[1]["n_citations"], means[1]["pct_rollouts_with_citation"], means[1]["n_episodes"]) == (0.5, 2.0, 0.5, 2)
    assert means[2]["judge"] is None and means[2]["cite_f1"] is None and means[None]["n_episodes"] == 1
    calls = spark.createDataFrame([(1, ["val/score", "batch/solve_none"]), (2, ["val/score"]), (3, None), (2, ["time"])], "step long, keys array<string>")
    gated = T.logged(T.component_means(infos), calls)
    assert [r["step"] for r in gated.collect()] == [1]
    # a call that names both is left out by a gate that asks for the absence of an evaluation, and step 2 stays its own
    wrong = calls.filter(~F.exists("keys", lambda k: k.startswith("val/")))
    assert wrong.filter(T.is_train_call(F.col("keys"))).count() == 0
    later = T.logged(T.component_means(infos), spark.createDataFrame([(2, ["actor/loss"])], "step long, keys array<string>")).first()
    assert (later["step"], later["n_episodes"], later["outcome"]) == (2, 1, 0.5)


def test_components_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(6), {c: rng.random() for c in rng.sample(T.COMPONENTS, 5)}) for _ in range(200)]
    table = spark.createDataFrame(rows, "step long, values map<string,double>")
    table.repartition(5).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    means, folder = T.component_means(s), f"file://{tmp_path}/out"
    q = sinks.run(means, sinks.upsert(folder, ["step"]), folder, "update")
    assert q.lastProgress["batchId"] >= 4
    got = sinks.latest(spark, folder, ", ".join(f"`{n}` {t}" for n, t in means.dtypes), ["step"])
    want = T.component_means(table)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_components_and_ramps_of_a_reward(spark):
    columns = "ep long, outcome double, f1 double, precision double, recall double, n_citations int, n_fabricated int, hit_rate double, format_error double, n_steps int, n_reads int, n_searches int, n_tool_calls int, done boolean, final_answer string, answers array<string>, at int"
    rows = spark.createDataFrame([(1, 1.0, 0.5, 0.5, 0.5, 2, 2, 1.0, 0.5, 4, 1, 1, 3, True, "red fox [T]", ["red fox"], 0), (2, 0.0, 0.5, 0.5, 0.5, 0, 0, 1.0, 0.0, 4, 1, 1, 3, False, "red", ["red fox"], 130), (3, 1.0, 0.0, 0.0, 0.0, 0, 0, 1.0, 0.0, 10, 1, 1, 3, True, None, [], None)], columns)
    by = lambda **how: {r["ep"]: (round(r["reward"], 6), r["values"]) for r in W.infos(rows, F.col("at"), **how).collect()}
    em, soft = by(), by(kind="f1", mode="additive")
    assert em[1][0] == round(0.75 - 0.5 - 0.05, 6) and em[1][1]["beta"] == 0.5 and em[1][1]["eff_toll"] == 0.0
    assert em[2][0] == round(-0.01 * 4, 6) and em[2][1]["beta"] == 0.15 and em[2][1]["capped"] == 1.0
    assert soft[2][0] == round(2 / 3 + 0.25 - 0.04, 6) and em[3][1]["lambda_eff"] == 0.0
    assert by(mode="cite_gated")[3][0] == 0.0
    assert set(em[1][1]) == set(T.COMPONENTS) - {"cite_uncited_claims"}
