import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import datasets as D
from tessera.operators import episode as E
from tessera.operators import rewards as W
from tessera.operators import evaluation as V
from tessera.operators import retrieval as R
from tessera.plans import catalogue
from tessera.sources import io


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_answer_metrics(spark):
    assert one(spark, X.exact_match(F.col("p"), F.col("g")), p="The USA.", g=["usa"])
    assert one(spark, X.token_f1(F.col("p"), F.col("g")), p="New York City", g=["New York"]) == pytest.approx(0.8)
    assert one(spark, X.token_f1(F.col("p"), F.col("g")), p="", g=[""]) == 1.0
    assert one(spark, X.answer_recall(F.col("p"), F.col("c")), p="red fox", c="a fox runs") == 0.5


def test_citations(spark):
    got = one(spark, X.citations(F.col("a")), a="It is so [Alpha]. And [2] more [Beta][Gamma]! End.")
    assert [tuple(c) for c in got] == [("Alpha", "It is so ."), ("Beta", "And  more !"), ("Gamma", "And  more !")]
    assert one(spark, X.uncited_claims(F.col("a")), a="It is so [Alpha]. Only a number [2]. End.") == 2


def test_actions(spark):
    got = one(spark, X.parse_action(F.col("t")), t="Thought: hm\nAction: Search[a [b] c]\nObservation: Action: read[x]")
    assert tuple(got) == ("hm", "search", "a [b] c", True)
    assert not one(spark, X.parse_action(F.col("t")), t="prose only")["parse_ok"]
    assert one(spark, X.parse_native_call(F.col("t")), t='<tool_call>{"name": "read", "arguments": "{\\"title\\": \\"T\\"}"}</tool_call>')["arguments"] == {"title": "T"}
    assert one(spark, X.parse_judge_score(F.col("t")), t="none") == 0.0 and one(spark, X.parse_judge_score(F.col("t")), t="12/10") == 10.0


def test_search_and_titles(spark):
    p = spark.createDataFrame([(1, 0, "Film", "a film about Zürich"), (1, 1, "Town", "a town"), (1, 2, "town", "other"), (1, 3, "Lake", "Film lake lake")], "task_id int, pos int, title string, text string")
    q = spark.createDataFrame([(7, 1, "film zurich rich")], "qid int, task_id int, query string")
    assert [r.title for r in R.search(q, p).orderBy("rank").collect()][0] == "Film"
    asked = spark.createDataFrame([(1, "film"), (1, "town"), (1, "TOWN"), (1, "none")], "task_id int, asked string")
    assert {r.asked: r.title for r in R.read_by_title(asked, p).collect()} == {"film": "Film", "town": "town", "TOWN": None, "none": None}
    twice = p.withColumn("title", F.lit("Green"))
    assert [r.title for r in R.suffix_repeated_titles(twice).orderBy("pos").collect()] == ["Green", "Green (2)", "Green (3)", "Green (4)"]


def episodes(spark, texts, ok=True):
    turns = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "ep long, t int, text string")
    tools = spark.createDataFrame([(1, i + 1, f"[{t[-6:-1]}]\nbody", ok, [t[-6:-1]]) for i, t in enumerate(texts)], "ep long, t int, obs string, ok boolean, titles array<string>")
    tasks = spark.createDataFrame([(1, "q", ["Alpha", "Gamma"], ["yes"])], "ep long, task_id string, gold array<string>, answers array<string>")
    eps = E.assemble(E.fold(turns, tools), tasks)
    return E.eval_rows(eps, E.citation_report(eps)).first()


def test_episode_cited_and_read(spark):
    r = episodes(spark, ["Action: read[Alpha]", "Action: read[Gamma]", "Action: answer[Yes [Alpha] [Gamma]]", "Action: read[Later]"])
    assert (r.done, r.n_steps, r.n_reads, r.f1, r.bucket) == (True, 3, 2, 1.0, "correct_and_cited")


def test_episode_cited_but_unread_and_fabricated(spark):
    r = episodes(spark, ["Action: read[Alpha]", "Action: answer[no [Gamma]]"])
    assert (r.f1, r.title_f1 > 0, r.n_fabricated, r.read_before_cite, r.bucket) == (0.0, True, 1, 0.0, "wrong_answer")


def test_episode_cap_and_empty_answer(spark):
    r = episodes(spark, ["prose"] * 8)
    assert (r.done, r.n_steps, r.n_tool_calls, r.format_error) == (False, 7, 0, 1.0)
    r = episodes(spark, ["Action: answer[]"])
    assert (r.done, r.final_answer, r.n_steps) == (True, "", 1)


def test_rewards_are_ordered(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 2, 0, 0.0, 3), (1.0, 0.0, 0, 0, 0.0, 3), (0.0, 0.0, 0, 0, 0.0, 3)], "outcome double, f1 double, n_citations int, n_fabricated int, format_error double, n_steps int")
    assert [r[0] for r in rows.select(W.reward(rows)[0]).collect()] == [1.0, 0.5, 0.0]


def test_aggregate_empty_and_missing(spark):
    rows = spark.createDataFrame([(1.0, True), (None, False), (3.0, None)], "a double, b boolean")
    got = V.aggregate(rows).first()
    assert (got.n, got.a, got.b) == (3, 2.0, 0.5)
    assert V.aggregate(rows.limit(0)).count() == 0


def test_draw_is_a_prefix(spark):
    rows = spark.range(200).withColumnRenamed("id", "i")
    ids = lambda n: [r.i for r in D.draw(rows, "i", n).collect()]
    assert ids(20) == ids(60)[:20]


def test_masks(spark):
    t = spark.createDataFrame([(1, 0, "user", "hi there"), (1, 1, "assistant", "bad call"), (1, 2, "user", "error: no"), (1, 3, "assistant", "ok."), (1, 4, "user", "bye")], "conv_id int, turn int, role string, text string")
    runs = [(r.begin, r.end) for r in D.graded_runs(D.token_rows(t)).collect()]
    assert runs == [(7, 9)]


def test_mask_leaks_are_found_in_the_text(spark, tmp_path):
    obs = "[Alpha]\nThe river Alpha runs to the north sea and back."
    chat = lambda i, last, body=obs: [(i, 0, "user", "Which river?"), (i, 1, "assistant", "Action: read[Alpha]"), (i, 2, "user", body), (i, 3, "assistant", last)]
    rows = chat(1, "Action: answer[North sea [Alpha].]") + chat(2, "Thought: the river  Alpha runs to the NORTH sea and so on\nAction: answer[North]") + chat(3, "Action: answer[short]", "too short") + [(4, 0, "user", "hi"), (5, 0, "assistant", "hello"), (5, 1, "assistant", "there")]
    t = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    t.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_runs, r.findings) for r in catalogue.QUERIES["mask_text_check"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, ""), 2: (2, "observation_graded"), 3: (2, ""), 4: (0, "nothing_graded"), 5: (1, "graded_from_start")}

    tokens, one = D.token_rows(t), t.filter("conv_id = 1")
    seen, answer = one.filter("turn = 2").selectExpr("conv_id", "text AS body"), spark.createDataFrame([(1, "North sea")], "conv_id int, answer string")
    of = lambda graded: D.mask_findings(one, tokens.filter("conv_id = 1").withColumn("graded", F.expr(graded)), seen, answer).first().findings
    assert of("graded") == []
    assert of("graded OR lead(turn) OVER (PARTITION BY conv_id ORDER BY at) = 3") == ["not_model_output"]
    assert of("false") == ["nothing_graded", "answer_not_graded"]
    assert set(of("turn = 2")) >= {"not_model_output", "observation_graded"}
    assert of("graded AND at % 2 = 0")[0] == "more_runs_than_turns"


def test_log_with_a_cut_line(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps({"task_id": "a", "n": 1}) + "\n" + '{"task_id": "b", "n"')
    good, bad = io.read_log(spark, str(tmp_path), "task_id string, n int")
    assert [r.task_id for r in good.collect()] == ["a"] and bad.count() == 1


def test_trajectories_round_trip_with_defaults(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"task_id": "a", "steps": [{"thought": "x", "ok": True}], "done": True}))
    step = io.read_trajectories(spark, str(tmp_path)).first().steps[0]
    assert step.parse_ok and step.retrieved_titles == []


def test_hop_rows_and_trainer_rows(spark):
    raw = spark.createDataFrame([("3hop1__7", "q", "x", ["x", "y"], [(0, "Green ", "a", True), (1, "Green", "b", True), (2, "Red", "c", False)])], "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>")
    row = io.hop_rows_to_tasks(raw).first()
    assert (row.supporting_titles, row.gold_aliases, row.n_hops) == (["Green", "Green (2)"], ["y"], 3)
    tasks = io.fixtures(spark)
    assert sorted(io.from_trainer_rows(io.to_trainer_rows(tasks, "s")).collect()) == sorted(tasks.collect())


def test_checkpoints(spark, tmp_path):
    for n in ("global_step_5/actor", "global_step_12/actor", "global_step_20", "other/actor"):
        (tmp_path / n).mkdir(parents=True)
    assert [r.step for r in io.checkpoint_steps(spark, str(tmp_path)).collect()] == [5, 12]


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 50
