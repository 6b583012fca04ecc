"""Named queries over native-call replies, failure causes, token prefixes, prompts and observations derived again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import native as N
from tessera.operators import prompts as P
from tessera.plans import views
from tessera.plans.catalogue import _passages, query
from tessera.plans.views import table

#: Native replies of the events view, in SQL that both engines read.
REPLY = """CASE WHEN event_type = 'view' THEN 'look first <tool_call>{"name": "search", "arguments": {"query": "T' || k || '"}}</tool_call>'
  WHEN event_type = 'signup' THEN '<tool_call>{"name": "fly", "arguments": {}}</tool_call>'
  WHEN event_type = 'click' THEN '<tool_call>{"name": " Read", "arguments": "{' || chr(92) || '"title' || chr(92) || '": 1}"}</tool_call>'
  WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN ' Answer ' || (user_id % 3) WHEN 1 THEN '<tool_call>{"name": "answer", "arguments": {"text": " A' || k || ' "}}</tool_call>'
    WHEN 2 THEN '<tool_call>{"name": "read", "arguments": [1]}</tool_call>' ELSE '<tool_call>{"name": "read", oops}</tool_call>' END
  WHEN event_id % 40 = 0 THEN '<tool_call>{"name": ' ELSE ' ' END"""
CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
READ = f"""nr AS (SELECT *, {REPLY} AS reply FROM ev), nb AS (SELECT *, regexp_extract(reply, '{CALL}', 1) AS body FROM nr),
nj AS (SELECT *, body <> '' AND json_valid(body) AS valid, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS js FROM nb),
nk AS (SELECT *, json_type(js, '$.arguments') AS kind_of, js ->> '$.arguments' AS args, lower(trim(coalesce(js ->> '$.name', ''))) AS fname FROM nj),
nl AS (SELECT *, valid AND (kind_of IS NULL OR kind_of = 'OBJECT' OR (kind_of = 'VARCHAR' AND json_valid(args))) AS readable FROM nk)"""
FOLD = f""", {READ},
nm AS (SELECT *, CASE WHEN NOT readable THEN CASE WHEN trim(reply) = '' THEN 'empty' ELSE 'plain_text' END WHEN fname NOT IN ('search', 'read', 'answer') THEN 'parse' WHEN fname = 'answer' THEN 'answer_tool' ELSE 'call' END AS kind FROM nl),
nn AS (SELECT *, min(CASE WHEN kind IN ('plain_text', 'answer_tool') THEN t END) OVER (PARTITION BY ep) AS stop FROM nm),
ns AS (SELECT nn.ep, nn.t, kind, raw.tool_ok, CASE WHEN kind = 'plain_text' THEN trim(reply) WHEN kind = 'answer_tool' THEN trim(js ->> '$.arguments.text') WHEN kind = 'call' THEN substring(obs, 1, 1200) END AS obs,
  kind IN ('call', 'answer_tool') AND NOT starts_with(reply, '<') AS thought FROM nn JOIN raw USING (ep, t) WHERE stop IS NULL OR nn.t <= stop)"""


def _native(spark, d):
    return N.fold_native(views._events(spark, d).selectExpr("ep", "t", f"{REPLY} AS text"), views.tools(spark, d))


@query(FOLD + " SELECT ep, t, kind, obs, CASE WHEN kind IN ('parse', 'empty') THEN kind WHEN kind = 'call' AND NOT tool_ok THEN 'tool_error' END AS error FROM ns", chain=True)
def native_fold(spark, d):
    return _native(spark, d).select("ep", "t", "kind", "obs", "error")


@query(FOLD + """ SELECT ep, coalesce(max(CASE WHEN kind IN ('plain_text', 'answer_tool') THEN kind END), 'round_limit') AS finish_mode, count(*)::BIGINT AS n_steps, count(*) FILTER (kind IN ('parse', 'empty'))::BIGINT AS n_retries,
  count(*) FILTER (thought)::BIGINT AS n_thoughts, max(CASE WHEN kind IN ('plain_text', 'answer_tool') THEN obs END) AS final_answer FROM ns GROUP BY ep""", chain=True)
def native_episodes(spark, d):
    return N.native_episodes(_native(spark, d), views.tasks(spark, d))


@query(f""", {READ} SELECT event_id, CASE WHEN body <> '' THEN CASE WHEN NOT readable THEN 'malformed_json_in_tool_call' WHEN fname IN ('search', 'read', 'answer') THEN 'parsed_ok' ELSE 'unknown_tool:' || fname END
  WHEN contains(reply, '<tool_call>') THEN CASE WHEN event_id % 3 = 0 THEN 'tool_call_truncated_by_length' ELSE 'tool_call_unclosed(stop=None)' END WHEN event_id % 3 = 0 THEN 'prose_truncated_by_length' ELSE 'plain_prose_no_tool_call' END AS cause FROM nl""", chain=True)
def native_causes(spark, d):
    ev = views._events(spark, d).selectExpr("event_id", f"{REPLY} AS text", "CASE WHEN event_id % 3 = 0 THEN 'length' ELSE 'stop' END AS finish", "cast(null AS string) AS stop")
    return ev.select("event_id", N.native_cause(F.col("text"), F.col("finish"), F.col("stop")).alias("cause"))


@query(" SELECT ep, t, CASE WHEN hit THEN 'parsed_ok' ELSE 'prose_no_react_syntax' END AS cause FROM p", chain=True)
def bracket_causes(spark, d):
    return views.turns(spark, d).select("ep", "t", N.bracket_cause(X.parse_action(F.col("text"))["parse_ok"], F.col("text")).alias("cause"))


@query("""WITH s AS (SELECT conv_id, turn, list_transform(range(1, 2 * turn + 3), lambda x: x + CASE WHEN conv_id % 3 = 0 AND turn = 2 AND x = 3 THEN 100 ELSE 0 END) AS prompt,
  [2 * turn + 3, 2 * turn + 4 + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END] AS done FROM conversations),
b AS (SELECT *, lag(list_concat(prompt, done)) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM s),
c AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(f), len(prompt)) + 1), lambda i: f[i] <> prompt[i])) - 1, least(len(f), len(prompt))) AS at_ FROM b WHERE f IS NOT NULL)
SELECT conv_id AS ep, turn AS t, len(f)::INT AS n_before, len(prompt)::INT AS n_prompt, at_::INT AS diverges_at FROM c WHERE at_ < len(f)""")
def prefix_breaks(spark, d):
    prompt = "transform(sequence(1, cast(2 * turn + 2 AS int)), x -> x + CASE WHEN conv_id % 3 = 0 AND turn = 2 AND x = 3 THEN 100 ELSE 0 END) AS prompt"
    done = "array(cast(2 * turn + 3 AS int), cast(2 * turn + 4 + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS int)) AS completion"
    return N.prefix_breaks(table(spark, d, "conversations").selectExpr("conv_id AS ep", "turn AS t", prompt, done))


TEMPLATE = P.Template(examples=("Thought: look\nAction: search[blue moon]",))
_HEAD = "\n\n".join([TEMPLATE.task, f"Tools:\n{TEMPLATE.tools}", f"Form:\n{TEMPLATE.form}"]).replace("'", "''")


@query(f"SELECT item_id, '{_HEAD}\n\n{TEMPLATE.cite}\n\nQuestion: ' || coalesce(text, '') AS student, '{_HEAD}\n\n{TEMPLATE.plain}\n\nExample 1:\n{TEMPLATE.examples[0]}\n\nQuestion: ' || coalesce(text, '') AS teacher FROM benchmark")
def opening_prompts(spark, d):
    return table(spark, d, "benchmark").select("item_id", TEMPLATE.render(F.col("text")).alias("student"), TEMPLATE.render(F.col("text"), citations=False, n_examples=1).alias("teacher"))


def _rebuilt(spark, d):
    turns = table(spark, d, "conversations")
    return turns, P.rebuild_first(turns, turns.filter("conv_id % 2 = 0").select("conv_id", F.concat(F.lit("prompt "), F.col("conv_id").cast("string")).alias("prompt")).distinct())


REBUILT = """WITH r AS (SELECT conv_id, turn, text AS old, CASE WHEN first_ THEN 'user' ELSE role END AS role, CASE WHEN first_ THEN 'prompt ' || conv_id ELSE text END AS text
  FROM (SELECT *, conv_id % 2 = 0 AND turn = min(turn) OVER (PARTITION BY conv_id) AS first_ FROM conversations))"""


@query(REBUILT + " SELECT conv_id, turn, role, text FROM r")
def rebuild_first_turn(spark, d):
    return _rebuilt(spark, d)[1]


@query(REBUILT + """, m AS (SELECT unnest(['e', 'prompt ', 'no such mark']) AS mark), c AS (SELECT mark, count(*) FILTER (contains(old, mark))::BIGINT AS n_before, count(*) FILTER (contains(text, mark))::BIGINT AS n_after FROM r, m GROUP BY mark)
SELECT *, CASE WHEN n_before = 0 THEN 'vacuous' WHEN n_after > 0 THEN 'still_there' ELSE 'removed' END AS verdict FROM c""")
def prompt_sentinels(spark, d):
    return P.sentinels(*_rebuilt(spark, d), ["e", "prompt ", "no such mark"])


@query("""WITH p AS (SELECT doc_id, doc_id // 10 AS task_id, doc_id % 10 AS pos, CASE WHEN doc_id % 2 = 0 THEN lang ELSE upper(lang) END AS title, coalesce(text, '') AS text FROM documents WHERE lang IS NOT NULL),
l AS (SELECT *, first_value(text) OVER (PARTITION BY task_id, title ORDER BY pos DESC) AS seen FROM p),
o AS (SELECT doc_id AS conv_id, title, substring('[' || title || ']' || chr(10) || text, 1, 1200) AS stored, substring('[' || title || ']' || chr(10) || seen, 1, 1200) AS again FROM l)
SELECT conv_id, CASE WHEN conv_id % 5 <> 0 THEN 'read' END AS name, CASE WHEN conv_id % 5 = 0 THEN 'action_not_at_line_start' WHEN stored <> again THEN 'observation_not_reproducible' END AS finding FROM o""")
def rederive_observations(spark, d):
    p = _passages(spark, d).filter("title is not null").withColumn("conv_id", F.expr("task_id * 10 + pos"))
    action = "CASE WHEN conv_id % 5 = 0 THEN 'so Action: read[x]' ELSE 'Thought: open' || chr(10) || ' Action: Read[' || title || ']' END"
    each = F.explode(F.expr(f"array(named_struct('turn', 1, 'role', 'assistant', 'text', {action}), named_struct('turn', 2, 'role', 'user', 'text', substring('[' || title || ']' || chr(10) || coalesce(text, ''), 1, 1200)))"))
    return P.rederive(p.select("conv_id", "task_id", each.alias("x")).select("conv_id", "task_id", "x.*"), p).select("conv_id", "name", "finding")
