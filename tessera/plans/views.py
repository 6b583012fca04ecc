"""Inputs of the catalogue's queries, derived from the driver tables, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT = """CASE WHEN event_type IN ('view', 'signup') THEN 'Thought: look' || chr(10) || 'Action: search[T' || k || ']'
  WHEN event_type = 'click' THEN 'Thought: open it' || chr(10) || 'Action: read[T' || k || ']'
  WHEN event_type = 'purchase' THEN 'Action: answer[The Answer ' || ((user_id + event_id % 2) % 3) || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' [T' || k || ']'
    WHEN 2 THEN ' [T' || k || '][t' || ((k + 3) % 12) || ']' ELSE '. It is so [T' || (user_id % 12) || ']! See [2]. And more.' END || ']'
  ELSE 'no action here' END"""
#: Both engines read this text; only JSON access and array literals differ.
OBS = """CASE WHEN event_type IN ('view', 'signup') THEN 'search results:' || chr(10) || '[1] T' || k || ': body' ELSE '[T' || k || ']' || chr(10) || 'body of T' || k || ' says answer ' || (k % 3) END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return ev.selectExpr("*", "user_id * 1000 + rn div 8 AS ep", "rn % 8 + 1 AS t", "cast(get_json_object(props, '$.k') as int) % 12 AS k")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("ep", "t", f"{TEXT} AS text")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = "CASE WHEN event_type IN ('view', 'signup') THEN array('T' || k, 'T' || ((k + 1) % 12), 'T' || ((k + 2) % 12)) ELSE array('T' || k) END"
    return _events(spark, sf_dir).selectExpr("ep", "t", f"{OBS} AS obs", "event_type <> 'click' OR k <> 11 AS ok", f"{titles} AS titles")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ep, task_id, gold titles, answers, arm and hops of every episode."""
    return _events(spark, sf_dir).selectExpr("ep", "concat('q-', user_id) AS task_id", "array('T' || (user_id % 12), 'T' || ((user_id * 5 + 1) % 12)) AS gold", "array('answer ' || (user_id % 3)) AS answers", "CASE WHEN ep % 2 = 0 THEN 'base' ELSE 'tuned' END AS arm", "cast(user_id % 3 + 2 AS int) AS hops").distinct()


#: The same chain for DuckDB: ev, turns, steps, eps, rep, rows.
CHAIN = rf"""
WITH ev0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
ev AS (SELECT *, user_id * 1000 + rn // 8 AS ep, rn % 8 + 1 AS t, json_extract_string(props, '$.k')::INT % 12 AS k FROM ev0),
raw AS (SELECT ep, t, {TEXT} AS text, {OBS} AS obs, event_type <> 'click' OR k <> 11 AS tool_ok,
  CASE WHEN event_type IN ('view', 'signup') THEN ['T' || k, 'T' || ((k + 1) % 12), 'T' || ((k + 2) % 12)] ELSE ['T' || k] END AS found FROM ev),
tasks AS (SELECT DISTINCT ep, 'q-' || user_id AS task_id, ['T' || (user_id % 12), 'T' || ((user_id * 5 + 1) % 12)] AS gold, 'answer ' || (user_id % 3) AS answer,
  CASE WHEN ep % 2 = 0 THEN 'base' ELSE 'tuned' END AS arm, (user_id % 3 + 2)::INT AS hops FROM ev),
p AS (SELECT *, regexp_matches(text, '(?m)Action:\s*([a-zA-Z_]+)\s*\[(.*)\]\s*$') AS hit, lower(regexp_extract(text, '(?m)Action:\s*([a-zA-Z_]+)\s*\[(.*)\]\s*$', 1)) AS act,
  trim(regexp_extract(text, '(?m)Action:\s*([a-zA-Z_]+)\s*\[(.*)\]\s*$', 2)) AS payload FROM raw),
q AS (SELECT *, least(coalesce(min(CASE WHEN act = 'answer' AND hit THEN t END) OVER (PARTITION BY ep), 8), 8) AS t_end FROM p),
steps AS (SELECT ep, t, CASE WHEN hit THEN act END AS name, CASE WHEN hit THEN payload END AS payload, hit AS parse_ok, hit AND (act = 'answer' OR tool_ok) AS ok,
  CASE WHEN NOT hit THEN 'parse' WHEN act = 'answer' OR tool_ok THEN NULL ELSE 'tool_error' END AS error,
  CASE WHEN act = 'answer' AND hit THEN payload ELSE substring(obs, 1, 1200) END AS obs, CASE WHEN hit AND act <> 'answer' AND tool_ok THEN found ELSE []::VARCHAR[] END AS titles
  FROM q WHERE t <= t_end AND (t < 8 OR hit)),
agg AS (SELECT ep, bool_or(coalesce(name = 'answer', false)) AS done, max(CASE WHEN name = 'answer' THEN payload END) AS final_answer, count(*)::INT AS n_steps, count(name)::INT AS n_tool_calls,
  count(*) FILTER (name = 'search')::INT AS n_searches, count(*) FILTER (name = 'read')::INT AS n_reads, count(*) FILTER (NOT parse_ok OR error IS NOT NULL)::INT AS n_bad, count(*) FILTER (NOT parse_ok)::INT AS n_unparsed,
  list_distinct(flatten(list(titles))) AS retrieved, list_distinct(flatten(list(CASE WHEN name = 'read' AND ok THEN titles ELSE [] END))) AS rd FROM steps GROUP BY ep),
eps AS (SELECT tasks.*, coalesce(done, false) AS done, final_answer, coalesce(n_steps, 0)::INT AS n_steps, coalesce(n_tool_calls, 0)::INT AS n_tool_calls, coalesce(n_searches, 0)::INT AS n_searches, coalesce(n_reads, 0)::INT AS n_reads,
  coalesce(n_bad, 0)::INT AS n_bad, coalesce(n_unparsed, 0)::INT AS n_unparsed, coalesce(retrieved, []) AS retrieved, coalesce(rd, []) AS rd FROM tasks LEFT JOIN agg USING (ep)),
sent AS (SELECT ep, unnest(string_split(regexp_replace(trim(coalesce(final_answer, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM eps),
sc AS (SELECT ep, s, list_filter(regexp_extract_all(s, '\[([^\]]+?)\]', 1), lambda x: NOT regexp_matches(x, '^\d+$')) AS ts, trim(regexp_replace(s, '\[[^\]]+?\]', '', 'g')) AS body FROM sent),
ct AS (SELECT ep, list_transform(flatten(list(ts)), lambda x: lower(trim(x))) AS cl, count(*) FILTER (body <> '' AND len(ts) = 0)::INT AS n_uncited FROM sc GROUP BY ep),
cc AS (SELECT eps.*, cl, n_uncited, list_distinct(cl) AS c, list_distinct(list_transform(gold, lambda x: lower(x))) AS g, list_transform(retrieved, lambda x: lower(x)) AS r, list_transform(rd, lambda x: lower(x)) AS d FROM eps JOIN ct USING (ep)),
cn AS (SELECT *, len(cl)::INT AS n_citations, len(list_filter(cl, lambda x: list_contains(r, x)))::INT AS n_resolved, len(list_filter(c, lambda x: list_contains(g, x) AND list_contains(d, x)))::INT AS tp,
  len(list_filter(c, lambda x: list_contains(g, x)))::INT AS ttp, len(list_filter(c, lambda x: list_contains(d, x)))::INT AS cr, len(c)::INT AS nc, len(g)::INT AS ng FROM cc),
cp AS (SELECT *, n_citations - n_resolved AS n_fabricated, nc - tp AS fp, ng - tp AS fn, CASE WHEN nc > 0 THEN tp::DOUBLE / nc ELSE 0 END AS "precision", CASE WHEN ng > 0 THEN tp::DOUBLE / ng ELSE 1 END AS recall,
  CASE WHEN nc > 0 THEN ttp::DOUBLE / nc ELSE 0 END AS title_precision, CASE WHEN ng > 0 THEN ttp::DOUBLE / ng ELSE 0 END AS title_recall, CASE WHEN nc > 0 THEN cr::DOUBLE / nc ELSE 0 END AS read_before_cite FROM cn),
rep AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / greatest("precision" + recall, 1e-12) ELSE 0 END AS f1,
  CASE WHEN title_precision + title_recall > 0 THEN 2 * title_precision * title_recall / greatest(title_precision + title_recall, 1e-12) ELSE 0 END AS title_f1 FROM cp),
norm AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(translate(lower(trim(regexp_replace(coalesce(final_answer, ''), '\[[^\]]+?\]', '', 'g'))), '.!,', ''), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ') AS pred,
  len(list_filter(regexp_split_to_array(translate(lower(coalesce(final_answer, '')), '.!,[]', ''), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')))::INT AS answer_words FROM rep),
ro AS (SELECT *, done AND pred = answer AS correct, CASE WHEN pred = '' THEN 0.0 ELSE 2.0::DOUBLE * len(list_filter(string_split(answer, ' '), lambda x: list_contains(string_split(pred, ' '), x))) / (len(string_split(pred, ' ')) + len(string_split(answer, ' '))) END AS answer_f1 FROM norm),
rows AS (SELECT *, correct::INT::DOUBLE AS outcome, CASE WHEN NOT correct THEN 'wrong_answer' WHEN n_citations = 0 THEN 'correct_uncited' WHEN f1 < 0.999 THEN 'correct_miscited' ELSE 'correct_and_cited' END AS bucket, n_tool_calls >= 8 AS capped,
  CASE WHEN n_steps = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, n_unparsed::DOUBLE / n_steps + CASE WHEN done THEN 0 ELSE 0.5 END) END AS format_error,
  CASE WHEN len(list_distinct(gold)) = 0 THEN 1.0 ELSE len(list_filter(list_distinct(gold), lambda x: list_contains(retrieved, x)))::DOUBLE / len(list_distinct(gold)) END AS hit_rate FROM ro)
"""
