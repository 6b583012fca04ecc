"""Named queries over whole rows: the classifier's, the citation report's, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import checks as C
from tessera.operators import classifier as K
from tessera.operators import datasets as D
from tessera.operators import episode as E
from tessera.operators import evaluation as V
from tessera.operators import native as N
from tessera.plans import grounding as G
from tessera.plans import views
from tessera.plans.catalogue import _episodes, _rows, query
from tessera.plans.views import table

_CLASS = """ep, task_id, n_unparsed = 0 AS parse_ok, n_unparsed AS n_parse_failures, n_reads > 0 AS calls_read, n_reads, n_searches, n_tool_calls, done AS terminated_cleanly, correct, n_citations, round(f1, 6) AS cite_f1,
round("precision", 6)::DOUBLE AS cite_precision, round(recall, 6)::DOUBLE AS cite_recall, round(title_f1, 6) AS title_f1, round(read_before_cite, 6)::DOUBLE AS read_before_cite_rate, bucket"""


@query(f"SELECT {_CLASS} FROM rows", chain=True)
def classifier_rows(spark, d):
    return K.classifier_rows(_rows(spark, d))


@query("SELECT ep, n_citations, n_resolved, n_fabricated, n_uncited, tp, fp, fn, ng AS n_gold, ttp AS title_tp, nc - ttp AS title_fp, ng - ttp AS title_fn, nc AS n_cited, cr AS n_cited_read FROM rep", chain=True)
def citation_counters(spark, d):
    return E.citation_report(_episodes(spark, d)).select("ep", *E.COUNTERS)


_LIST = "(SELECT coalesce(string_agg(v || ':' || n, ',' ORDER BY v), '') FROM ({}))"
_KEPT = "correct AND cite_f1 >= {}"


@query(f""", k AS (SELECT {_CLASS}, len(list_filter(regexp_split_to_array(trim(coalesce(final_answer, '')), '\\s+'), lambda x: x <> '')) AS words FROM rows)
SELECT count(*)::BIGINT AS n, count(DISTINCT task_id)::BIGINT AS questions, {", ".join(f"round(avg({c}::DOUBLE), 6) AS {n}" for c, n in (("correct::INT", "correct_rate"), ("cite_f1", "mean_cite_f1"), ("title_f1", "mean_title_f1"), ("read_before_cite_rate", "mean_read_before_cite"), ("calls_read::INT", "calls_read_rate"), ("terminated_cleanly::INT", "terminated_cleanly_rate"), ("parse_ok::INT", "parse_ok_rate"), ("n_reads", "mean_n_reads"), ("n_searches", "mean_n_searches")))},
  count(*) FILTER (ep % 7 = 0)::BIGINT AS gave_up, {", ".join(f"count(*) FILTER ({_KEPT.format(b)})::BIGINT AS kept_{i}, count(DISTINCT CASE WHEN {_KEPT.format(b)} THEN task_id END)::BIGINT AS questions_{i}" for i, b in enumerate(K.BARS))},
  (SELECT coalesce(max(m), 0)::BIGINT FROM (SELECT count(*) AS m FROM k WHERE {_KEPT.format(K.BARS[0])} GROUP BY task_id)) AS most_of_a_question,
  {_LIST.format("SELECT bucket AS v, count(*) AS n FROM k GROUP BY 1")} AS buckets, {_LIST.format("SELECT lpad(n_tool_calls::VARCHAR, 2, '0') AS v, count(*) AS n FROM k GROUP BY 1")} AS hops,
  {_LIST.format(f"SELECT lpad(n_tool_calls::VARCHAR, 2, '0') AS v, count(*) AS n FROM k WHERE {_KEPT.format(K.BARS[0])} GROUP BY 1")} AS kept_hops, {_LIST.format(f"SELECT lpad(words::VARCHAR, 4, '0') AS v, count(*) AS n FROM k WHERE {_KEPT.format(K.BARS[0])} GROUP BY 1")} AS answer_lengths FROM k""", chain=True)
def quality_report(spark, d):
    rows = _rows(spark, d)
    return K.quality_report(K.classifier_rows(rows), rows, rows.filter("ep % 7 = 0"))


@query("SELECT ep, correct FROM rows WHERE done AND n_citations > 0 AND read_before_cite >= 0.999 AND ep % 11 <> 0 AND ep % 7 <> 0", chain=True)
def process_clean_collected(spark, d):
    rows = _rows(spark, d).withColumns({"has_history": F.when(F.col("ep") % 11 != 0, True), "gave_up": F.when(F.col("ep") % 7 == 0, True)})
    return D.process_clean(rows).select("ep", "correct")


#: Roles with faults at known places: the fourth turn of every third conversation repeats the third's role.
_ROLES = "CASE WHEN conv_id % 3 = 0 AND turn = 3 THEN 'user' WHEN conv_id % 4 = 0 AND turn = 2 THEN 'assistant' ELSE role END AS role"


@query(f"WITH t AS (SELECT conv_id, turn, {_ROLES} FROM conversations), p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t) SELECT conv_id, min(turn) AS turn, arg_min(before, turn) AS before, arg_min(role, turn) AS role FROM p WHERE before = role GROUP BY conv_id")
def first_violations(spark, d):
    return D.first_violations(table(spark, d, "conversations").selectExpr("conv_id", "turn", _ROLES))


_TASK = "CASE WHEN (ep {div} 1000) % 3 = 0 THEN concat('hotpot-', ep {div} 1000) ELSE concat('q-', ep {div} 1000) END"
_SLICED = "count(*)::BIGINT AS n, round(avg(correct::INT::DOUBLE), 6) AS correct, round(avg(f1), 6) AS f1, round(avg((bucket = 'correct_and_cited')::INT::DOUBLE), 6) AS good, round(avg(capped::INT::DOUBLE), 6) AS capped"


@query(f""", u AS (SELECT * EXCLUDE (task_id, hops), {_TASK.format(div='//')} AS task_id, ep // 1000 AS q FROM rows),
m AS (SELECT *, CASE WHEN q % 2 = 0 AND q % 4 = 0 THEN 'musique' ELSE split_part(task_id, '-', 1) END AS dataset, CASE WHEN q % 2 = 0 AND q % 5 <> 0 THEN q % 5 WHEN (q % 4 <> 0) AND q % 3 = 0 THEN 2 END AS h FROM u)
SELECT 'dataset' AS slice, dataset AS value, {_SLICED} FROM m GROUP BY 2 UNION ALL SELECT 'n_hops', h::VARCHAR, {_SLICED} FROM m WHERE h IS NOT NULL GROUP BY 2 UNION ALL SELECT 'all', '', {_SLICED} FROM m""", chain=True)
def slices_with_fallback(spark, d):
    rows = _rows(spark, d).withColumn("task_id", F.expr(_TASK.format(div="div")))
    meta = rows.selectExpr("task_id", "ep div 1000 AS q").distinct().filter("q % 2 = 0").selectExpr("task_id", "CASE WHEN q % 4 = 0 THEN 'musique' ELSE '' END AS dataset", "cast(q % 5 AS int) AS n_hops")
    return V.slices(V.with_meta(rows, meta), "dataset", "n_hops").filter("slice <> 'n_hops' OR value <> ''")


_MEASURES = ["read_before_cite", "calls_read", "correct", "done", "n_citations", "title_f1"]
_THREE = ", mr AS (SELECT *, n_reads > 0 AS calls_read FROM rows), m AS (SELECT task_id, " + ", ".join(
    f"round(avg({c}{'::INT' if c in ('calls_read', 'correct', 'done') else ''}::DOUBLE) FILTER (ep % 3 = {k}), 6) AS {p}_{c}" for k, p in enumerate("bet") for c in _MEASURES
) + " FROM mr GROUP BY task_id)"


@query(_THREE + """ SELECT task_id, array_to_string(list_filter([CASE WHEN round(t_read_before_cite - b_read_before_cite, 6) < 0.1 THEN 'read_before_cite' END, CASE WHEN round(t_calls_read - b_calls_read, 6) < 0.1 THEN 'calls_read' END,
CASE WHEN round(t_correct - b_correct, 6) < -0.02 THEN 'correct' END, CASE WHEN round(t_done - b_done, 6) < -0.02 THEN 'done' END,
CASE WHEN t_n_citations > 2 * greatest(0.5, b_n_citations) AND round(t_title_f1 - b_title_f1, 6) <= 0 THEN 'n_citations' END], lambda x: x IS NOT NULL), ',') AS failed,
array_to_string(list_filter([CASE WHEN round(t_read_before_cite - e_read_before_cite, 6) > 0 THEN 'read_before_cite' END, CASE WHEN round(t_correct - e_correct, 6) > 0 THEN 'correct' END], lambda x: x IS NOT NULL), ',') AS beats_prompting FROM m""", chain=True)
def sft_gate_three_arms(spark, d):
    rows = _rows(spark, d).withColumns({"calls_read": F.col("n_reads") > 0, "arm": F.element_at(F.array(F.lit("base"), F.lit("example"), F.lit("tuned")), (F.col("ep") % 3 + 1).cast("int"))})
    means = C.arm_means(rows, "task_id", {"b": "base", "e": "example", "t": "tuned"}, _MEASURES)
    return means.select("task_id", F.array_join(C.sft_gate(), ",").alias("failed"), F.array_join(C.beats_prompting(), ",").alias("beats_prompting"))


@query(f""", {G.READ}, cs AS (SELECT 'native' AS style, CASE WHEN event_id % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, CASE WHEN body <> '' THEN CASE WHEN NOT readable THEN 'malformed_json_in_tool_call' WHEN fname IN ('search', 'read', 'answer') THEN 'parsed_ok' ELSE 'unknown_tool:' || fname END
  WHEN contains(reply, '<tool_call>') THEN CASE WHEN event_id % 3 = 0 THEN 'tool_call_truncated_by_length' ELSE 'tool_call_unclosed(stop=None)' END WHEN event_id % 3 = 0 THEN 'prose_truncated_by_length' ELSE 'plain_prose_no_tool_call' END AS cause FROM nl
  UNION ALL SELECT 'bracket', CASE WHEN (ep + t) % 4 = 0 THEN 'None' ELSE 'stop' END, CASE WHEN hit THEN 'parsed_ok' ELSE 'prose_no_react_syntax' END FROM p),
x AS (SELECT style, 'cause' AS what, cause AS value FROM cs UNION ALL SELECT style, 'finish_reason', finish_reason FROM cs)
SELECT style, what, value, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY style, what), 6) AS share FROM x GROUP BY style, what, value""", chain=True)
def cause_report(spark, d):
    ev = views._events(spark, d).selectExpr(f"{G.REPLY} AS text", "CASE WHEN event_id % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason")
    native = ev.select(F.lit("native").alias("style"), N.native_cause(F.col("text"), F.col("finish_reason"), F.lit(None).cast("string")).alias("cause"), "finish_reason")
    turns = views.turns(spark, d).select(F.lit("bracket").alias("style"), N.bracket_cause(X.parse_action(F.col("text"))["parse_ok"], F.col("text")).alias("cause"), F.when((F.col("ep") + F.col("t")) % 4 != 0, "stop").alias("finish_reason"))
    return K.cause_report(native.unionByName(turns))


@query(G.FOLD + """, e AS (SELECT ep, coalesce(max(CASE WHEN kind IN ('plain_text', 'answer_tool') THEN kind END), 'round_limit') AS finish_mode, count(*) FILTER (kind IN ('parse', 'empty')) AS retries, count(*) FILTER (thought) AS thoughts FROM ns GROUP BY ep)
SELECT finish_mode, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, round(avg(retries::DOUBLE), 6) AS mean_retries, round(avg((thoughts > 0)::INT::DOUBLE), 6) AS any_thought_rate FROM e GROUP BY 1""", chain=True)
def finish_report(spark, d):
    return K.finish_report(G.native_episodes(spark, d))
