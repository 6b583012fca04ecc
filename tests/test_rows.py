"""Whole rows and reports on a few hand-made episodes."""

from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.operators import classifier as K
from tessera.operators import datasets as D
from tessera.operators import episode as E
from tessera.operators import evaluation as V


def test_counters_of_a_citation_report(spark):
    step = "array<struct<t:int,thought:string,name:string,payload:string,parse_ok:boolean,ok:boolean,error:string,obs:string,titles:array<string>>>"
    read = lambda t, *titles: (t, None, "read", "x", True, True, None, "o", list(titles))
    rows = [
        (1, "A is so [Gold One]. It is [gold two][Made up]. And more.", ["Gold One", "Gold Two", "Gold Three"], ["Gold One", "Gold Two"], [read(1, "Gold One")]),
        (2, None, [], [], []),
    ]
    eps = spark.createDataFrame(rows, f"ep long, final_answer string, gold array<string>, retrieved array<string>, steps {step}")
    got = {r["ep"]: r.asDict() for r in E.citation_report(eps).collect()}
    want = {"n_citations": 3, "n_resolved": 2, "n_fabricated": 1, "n_uncited": 1, "tp": 1, "fp": 2, "fn": 2, "n_gold": 3, "title_tp": 2, "title_fp": 1, "title_fn": 1, "n_cited": 3, "n_cited_read": 1}
    assert {k: got[1][k] for k in E.COUNTERS} == want and list(want) == E.COUNTERS
    assert all(got[2][k] == 0 for k in E.COUNTERS)


def test_process_clean_asks_for_history_and_service(spark):
    rows = spark.createDataFrame([(1, True, 1, 1.0, True, None), (2, True, 1, 1.0, None, False), (3, True, 1, 1.0, True, True), (4, False, 1, 1.0, True, False), (5, True, 1, 0.5, True, False), (6, None, 1, 1.0, True, False)], "ep int, done boolean, n_citations int, read_before_cite double, has_history boolean, gave_up boolean")
    assert [r["ep"] for r in D.process_clean(rows).collect()] == [1]
    assert [r["ep"] for r in D.process_clean(rows.drop("has_history", "gave_up")).collect()] == [1, 2, 3]


def test_first_violations(spark):
    turns = [(1, 0, "user"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "assistant"), (2, 0, "user"), (2, 1, "assistant"), (3, 0, None), (3, 1, None)]
    assert [tuple(r) for r in D.first_violations(spark.createDataFrame(turns, "conv_id int, turn int, role string")).collect()] == [(1, 1, "user", "user")]


def test_fallbacks_of_source_and_hops(spark):
    rows = spark.createDataFrame([("hotpot-1",), ("hotpotqa-2",), ("2wiki-3",), ("m-4",), ("plain",), ("hotpot-6",)], "task_id string")
    meta = spark.createDataFrame([("m-4", "musique", 3), ("2wiki-3", "", 0), ("hotpot-6", None, 4), ("m-4", "musique", 3)], "task_id string, dataset string, n_hops int")
    got = {r["task_id"]: (r["dataset"], r["n_hops"]) for r in V.with_meta(rows, meta).collect()}
    assert got == {"hotpot-1": ("hotpot", 2), "hotpotqa-2": ("hotpotqa", 2), "2wiki-3": ("2wiki", None), "m-4": ("musique", 3), "plain": ("plain", None), "hotpot-6": ("hotpot", 4)}


def test_three_arms(spark):
    measures = ["read_before_cite", "calls_read", "correct", "done", "n_citations", "title_f1"]
    arms = {"base": (0.1, 0, 1, 1, 1, 0.5), "example": (0.9, 1, 0, 1, 1, 0.5), "tuned": (0.6, 1, 1, 0, 5, 0.5)}
    rows = spark.createDataFrame([("all", a, *map(float, v)) for a, v in arms.items()], f"grp string, arm string, {', '.join(f'{m} double' for m in measures)}")
    got = C.arm_means(rows, "grp", {"b": "base", "e": "example", "t": "tuned"}, measures).select(C.sft_gate().alias("failed"), C.beats_prompting().alias("beats")).first()
    assert got["failed"] == ["done", "n_citations"] and got["beats"] == ["correct"]
    none = C.arm_means(rows.filter("arm <> 'example'"), "grp", {"b": "base", "e": "example", "t": "tuned"}, measures)
    assert none.first()["e_correct"] is None and none.select(C.beats_prompting().alias("beats")).first()["beats"] == []


def test_quality_report(spark):
    schema = "ep long, task_id string, parse_ok boolean, n_parse_failures int, calls_read boolean, n_reads int, n_searches int, n_tool_calls int, terminated_cleanly boolean, correct boolean, n_citations int, cite_f1 double, cite_precision double, cite_recall double, title_f1 double, read_before_cite_rate double, bucket string"
    make = lambda ep, task, calls, right, f1, bucket: (ep, task, True, 0, calls > 1, 1, 2, calls, True, right, 1, f1, f1, f1, f1, 1.0, bucket)
    rows = spark.createDataFrame([make(1, "a", 3, True, 1.0, "correct_and_cited"), make(2, "a", 3, True, 1.0, "correct_and_cited"), make(3, "b", 8, True, 0.5, "correct_miscited"), make(4, "b", 1, False, 1.0, "wrong_answer")], schema)
    answers = spark.createDataFrame([(1, "one two"), (2, " one  "), (3, None), (4, "x")], "ep long, final_answer string")
    r = K.quality_report(rows, answers, spark.createDataFrame([(4,), (4,), (9,)], "ep long")).first()
    assert (r["n"], r["questions"], r["gave_up"], r["correct_rate"], r["most_of_a_question"]) == (4, 2, 1, 0.75, 2)
    assert [(r[f"kept_{k}"], r[f"questions_{k}"]) for k in range(4)] == [(2, 1), (2, 1), (3, 2), (3, 2)]
    assert (r["buckets"], r["hops"], r["kept_hops"], r["answer_lengths"]) == ("correct_and_cited:2,correct_miscited:1,wrong_answer:1", "01:1,03:2,08:1", "03:2", "0001:1,0002:1")
    none = K.quality_report(rows.limit(0), answers, answers.select("ep")).first()
    assert none["n"] == 0 and none["correct_rate"] is None and none["most_of_a_question"] == 0 and none["buckets"] == ""


def test_cause_and_finish_reports(spark):
    causes = spark.createDataFrame([("n", "ok", "stop"), ("n", "ok", "length"), ("n", "bad", None), ("b", "ok", "stop")], "style string, cause string, finish_reason string")
    got = {(r["style"], r["what"], r["value"]): (r["n"], r["share"]) for r in K.cause_report(causes).collect()}
    assert got[("n", "cause", "ok")] == (2, 0.666667) and got[("n", "finish_reason", "None")] == (1, 0.333333) and got[("b", "cause", "ok")] == (1, 1.0)
    eps = spark.createDataFrame([("plain_text", 0, 2), ("plain_text", 3, 0), ("dead", 0, 0)], "finish_mode string, n_retries int, n_thoughts int")
    got = {r["finish_mode"]: tuple(r)[1:] for r in K.finish_report(eps).collect()}
    assert got == {"plain_text": (2, 0.666667, 1.5, 0.5), "dead": (1, 0.333333, 0.0, 0.0)}


def test_whole_row_has_sixteen_values(spark, sf_dir):
    from tessera.plans.rows import classifier_rows

    rows = classifier_rows(spark, sf_dir)
    assert len(rows.columns) == 17 and rows.select("bucket").distinct().count() > 2 and rows.filter(F.col("n_parse_failures") > 0).count() > 0
