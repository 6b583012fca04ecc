"""Named queries over tool calls, verified citations, gates, validation of collected rows and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.operators import native as N
from tessera.operators import tools as T
from tessera.plans import grounding as G
from tessera.plans import views
from tessera.plans.catalogue import _episodes, _groups, _rows, _steps, query
from tessera.plans.catalogue import tiers as tier_rows
from tessera.plans.views import table

# ---- tools

#: Calls of every kind, one per event, in SQL that both engines read.
NAME = "CASE WHEN event_id % 10 IN (0, 8, 9) THEN 'search' WHEN event_id % 10 = 1 THEN 'fly' WHEN event_id % 10 IN (5, 6) THEN 'answer' ELSE 'read' END"
ARGS = {0: ("query", "'qq' || user_id"), 2: None, 3: ("title", "'T1'", "x", "'1'"), 4: ("title", "'T99'"), 5: ("text", "' '"), 6: ("text", "' A' || user_id"), 7: ("title", "' t' || (user_id % 12)"), 8: ("query", "'qq1'", "k", "'two'"), 9: ("query", "' '")}


def _args(join: str, empty: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {join.format(', '.join(x if i % 2 else repr(x) for i, x in enumerate(v)))}" for k, v in ARGS.items() if v)
    return f"CASE event_id % 10 {whens} ELSE {empty} END"


PASSAGES = "SELECT 0 AS task_id, id AS pos, concat('T', id) AS title, concat('body qq', id) AS text FROM range(12)"


@query(f"""WITH c AS (SELECT event_id AS id, user_id, event_id % 10 AS kind, {NAME} AS name FROM events),
r AS (SELECT id, name, CASE kind WHEN 1 THEN 'unknown_tool' WHEN 2 THEN 'missing_arg' WHEN 3 THEN 'unexpected_arg' WHEN 8 THEN 'internal_error' WHEN 4 THEN 'tool_error' WHEN 5 THEN 'tool_error' WHEN 9 THEN 'tool_error' END AS error,
  CASE kind WHEN 0 THEN CASE WHEN user_id < 12 THEN 'search results:' || chr(10) || '[1] T' || user_id || ': body qq' || user_id ELSE 'no results.' END
  WHEN 1 THEN 'error: unknown tool ''fly''' WHEN 2 THEN 'error: read missing required arg(s): title' WHEN 3 THEN 'error: read got unexpected arg(s): x' WHEN 4 THEN 'error: read: no passage titled ''T99''.'
  WHEN 5 THEN 'error: answer: empty answer.' WHEN 6 THEN 'A' || user_id WHEN 7 THEN '[T' || (user_id % 12) || ']' || chr(10) || 'body qq' || (user_id % 12) WHEN 8 THEN 'error: internal (k is no number)' ELSE 'error: search: empty query.' END AS obs,
  CASE WHEN kind = 7 OR (kind = 0 AND user_id < 12) THEN 'T' || (user_id % 12) ELSE '' END AS titles FROM c)
SELECT id, name, error IS NULL AS ok, error, obs, titles FROM r""")
def tool_execute(spark, d):
    calls = table(spark, d, "events").selectExpr("event_id AS id", "0L AS task_id", f"{NAME} AS name", f"{_args('map({})', 'cast(map() AS map<string,string>)')} AS args")
    return T.execute(calls, spark.sql(PASSAGES)).select("id", "name", "ok", "error", "obs", F.array_join("titles", ",").alias("titles"))


#: Each nation offers tools of its own, one of them unknown.
OFFERED = "CASE n_nationkey % 4 WHEN 0 THEN {a}'search'{b} WHEN 1 THEN {a}'read', 'fly', 'search'{b} WHEN 2 THEN {a}'fly'{b} ELSE {a}'answer', 'read'{b} END"


@query(f"""SELECT n_nationkey, array_to_string(list_filter(list_transform({OFFERED.format(a="[", b="]")}, lambda x: CASE x WHEN 'search' THEN '- search(query, k?): titles and first words of the best passages'
  WHEN 'read' THEN '- read(title): a passage''s whole text' WHEN 'answer' THEN '- answer(text): your answer; this ends the episode' END), lambda x: x IS NOT NULL), chr(10)) AS menu FROM nation""")
def tool_menu(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.menu_of(F.expr(OFFERED.format(a="array(", b=")"))).alias("menu"))


# ---- citations

VERIFY = r""", evd AS (SELECT ep, lower(titles[1]) AS nt, arg_max(regexp_replace(obs, '(?s)^\[.*?\]\n', ''), t) AS body FROM steps WHERE name = 'read' AND ok GROUP BY ALL),
cz AS (SELECT ep, s, trim(unnest(ts)) AS title, body AS claim FROM sc),
cy AS (SELECT cz.*, lower(title) AS nt, list_contains(list_transform(eps.retrieved, lambda x: lower(x)), lower(title)) AS resolved, list_contains(list_transform(gold, lambda x: lower(x)), lower(title)) AS is_gold, evd.body AS body,
  regexp_extract_all(lower(claim), '[a-z0-9]+') AS a, regexp_extract_all(lower(coalesce(evd.body, '')), '[a-z0-9]+') AS b FROM cz JOIN eps USING (ep) LEFT JOIN evd ON evd.ep = cz.ep AND evd.nt = lower(title)),
cx AS (SELECT *, CASE WHEN body IS NULL OR len(a) = 0 THEN 0 ELSE len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) END AS overlap FROM cy)"""


def _verify(backend: str, score: str, bar: float) -> None:
    def run(spark, d):
        return C.verify(_episodes(spark, d), _steps(spark, d), backend).select("ep", "title", "claim", "resolved", "fabricated", F.round("alignment", 6).alias("alignment"), "verified")

    run.__name__ = f"citation_verify_{backend}"
    query(VERIFY + f" SELECT ep, title, claim, resolved, NOT resolved AS fabricated, round(({score})::DOUBLE, 6) AS alignment, body IS NOT NULL AND ({score}) >= {bar} AS verified FROM cx", chain=True)(run)


_verify("overlap", "overlap", C.SUPPORT)
_verify("gold", "is_gold::INT", 1.0)


@query(VERIFY + f""", cw AS (SELECT *, body IS NOT NULL AND overlap >= {C.SUPPORT} AS verified FROM cx),
p AS (SELECT ep, count(*) AS n, count(*) FILTER (resolved) AS r, count(*) FILTER (verified) AS v, count(*) FILTER (NOT resolved) AS f, count(DISTINCT CASE WHEN verified THEN nt END) AS s FROM cw GROUP BY ep)
SELECT ep, coalesce(n, 0)::BIGINT AS n_citations, coalesce(r, 0)::BIGINT AS n_resolved, coalesce(v, 0)::BIGINT AS n_verified, coalesce(f, 0)::BIGINT AS n_fabricated, coalesce(s, 0)::BIGINT AS distinct_verified_sources,
  round(coalesce(v::DOUBLE / n, 0), 6) AS verified_frac FROM eps LEFT JOIN p USING (ep)""".replace("p AS (SELECT ep, count", "vp AS (SELECT ep, count").replace("LEFT JOIN p USING", "LEFT JOIN vp USING"), chain=True)
def citation_verification_report(spark, d):
    eps = _episodes(spark, d)
    out = C.verification_report(eps, C.verify(eps, _steps(spark, d)))
    names = [c for c in out.columns if c not in ("ep", "verified_frac")]
    return out.select("ep", *[F.col(c).cast("long").alias(c) for c in names], F.round("verified_frac", 6).alias("verified_frac"))


SHOWN = "SELECT ep, coalesce(string_agg(obs, chr(10) ORDER BY t) FILTER (name IN ('search', 'read') AND ok), '') AS shown FROM steps GROUP BY ep"


@query(f", sh AS ({SHOWN}) SELECT eps.ep, coalesce(shown, '') AS text FROM eps LEFT JOIN sh USING (ep)", chain=True)
def retrieved_text(spark, d):
    return _episodes(spark, d).select("ep", C.retrieved_text(F.col("steps")).alias("text"))


@query(f""", sh AS ({SHOWN}) SELECT eps.ep, 'Rate from 0 to 10 how far the passages support the answer. What they don''t say counts against it. Reply with the number alone.' || chr(10) || chr(10) || 'Question: ' || task_id || chr(10)
  || 'Passages:' || chr(10) || substring(coalesce(shown, ''), 1, 60) || chr(10) || 'Answer: ' || coalesce(final_answer, '') || chr(10) || chr(10) || 'Rating:' AS prompt FROM eps LEFT JOIN sh USING (ep)""", chain=True)
def rubric_prompt(spark, d):
    return _episodes(spark, d).select("ep", C.rubric_prompt(F.col("task_id"), F.col("steps"), F.col("final_answer"), 60).alias("prompt"))


# ---- gates

#: Summaries of two arms for 420 groups of events, such that every probe holds somewhere.
ARMS = """SELECT user_id % 420 AS grp, max(0.5) AS b_em, max(round(0.5 + (user_id % 4) * 0.03, 6)) AS t_em, max(0.6) AS b_hit_rate, max(round(0.6 + (user_id % 3) * 0.02, 6)) AS t_hit_rate, max(1 + user_id % 3) AS t_n_steps,
max(0.1) AS b_fabricated, max(round(0.1 + (user_id % 5) * 0.02, 6)) AS t_fabricated, max(10.0) AS b_words, max(round(10 * (1 + (user_id % 7) * 0.2), 6)) AS t_words, max(0.5) AS b_f1, max(round(0.47 + (user_id % 2) * 0.08, 6)) AS t_f1, max(round(0.5 + (user_id % 6) * 0.1, 6)) AS t_judge
FROM events GROUP BY user_id % 420"""
_ARMS = "WITH a AS (SELECT grp, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in ("b_em", "t_em", "b_hit_rate", "t_hit_rate", "t_n_steps", "b_fabricated", "t_fabricated", "b_words", "t_words", "b_f1", "t_f1", "t_judge")) + f" FROM ({ARMS}))"
FIRED = """list_filter([CASE WHEN round(t_judge - t_f1, 6) > 0.25 THEN 'JUDGE-GAMING' END, CASE WHEN round(t_em - b_em, 6) > 0.02 AND round(t_hit_rate - b_hit_rate, 6) <= 0.01 THEN 'MEMORY-GUESSING' END, CASE WHEN t_n_steps < 1.5 THEN 'TOOL-AVOIDANCE' END,
CASE WHEN round(t_fabricated - b_fabricated, 6) > 0.05 THEN 'FABRICATION' END, CASE WHEN t_words > round(1.5 * b_words, 6) AND round(t_f1 - b_f1, 6) <= 0.02 THEN 'LENGTH-INFLATION' END], lambda x: x IS NOT NULL)"""


def _arms(spark, d):
    df = spark.sql(ARMS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    return df.select("grp", *[F.col(c).cast("double").alias(c) for c in df.columns if c != "grp"])


@query(_ARMS + f" SELECT grp, array_to_string({FIRED}, '; ') AS probes FROM a")
def eval_probes_by_group(spark, d):
    return _arms(spark, d).select("grp", F.array_join(C.probes(), "; ").alias("probes"))


@query(_ARMS + f", g AS (SELECT grp, list_concat(list_filter([CASE WHEN round(t_em - b_em, 6) < 0.05 THEN 'em gain' END, CASE WHEN round(t_f1 - b_f1, 6) < -0.02 THEN 'f1 loss' END], lambda x: x IS NOT NULL), {FIRED}) AS r FROM a) SELECT grp, len(r) = 0 AS passed, array_to_string(r, '; ') AS reasons FROM g")
def eval_gate_by_group(spark, d):
    return _arms(spark, d).withColumn("r", C.eval_gate()).select("grp", (F.size("r") == 0).alias("passed"), F.array_join("r", "; ").alias("reasons"))


MEASURES = ["correct", "done", "f1", "title_f1", "read_before_cite", "calls_read", "n_citations", "n_steps", "answer_words"]
BOTH = ", mr AS (SELECT *, n_reads > 0 AS calls_read FROM rows), m AS (SELECT hops, " + ", ".join(f"round(avg({c}::INT::DOUBLE) FILTER (arm = '{a}'), 6) AS {p}_{c}" if c in ("correct", "done", "calls_read") else f"round(avg({c}::DOUBLE) FILTER (arm = '{a}'), 6) AS {p}_{c}" for a, p in (("base", "b"), ("tuned", "t")) for c in MEASURES) + " FROM mr GROUP BY hops)"


def _both(spark, d):
    return C.both_arms(_rows(spark, d).withColumn("calls_read", F.col("n_reads") > 0), "hops", "base", "tuned", MEASURES)


@query(BOTH + """ SELECT hops, array_to_string(list_filter([CASE WHEN round(t_read_before_cite - b_read_before_cite, 6) < 0.1 THEN 'read_before_cite' END, CASE WHEN round(t_calls_read - b_calls_read, 6) < 0.1 THEN 'calls_read' END,
CASE WHEN round(t_correct - b_correct, 6) < -0.02 THEN 'correct' END, CASE WHEN round(t_done - b_done, 6) < -0.02 THEN 'done' END,
CASE WHEN t_n_citations > 2 * greatest(0.5, b_n_citations) AND round(t_title_f1 - b_title_f1, 6) <= 0 THEN 'n_citations' END], lambda x: x IS NOT NULL), ',') AS failed FROM m""", chain=True)
def sft_gate(spark, d):
    return _both(spark, d).select("hops", F.array_join(C.sft_gate(), ",").alias("failed"))


@query(BOTH + """ SELECT hops, array_to_string(list_filter([CASE WHEN round(t_correct - b_correct, 6) <= 0 THEN 'correct' END, CASE WHEN round(t_f1 - b_f1, 6) < -0.02 THEN 'f1' END, CASE WHEN round(t_read_before_cite - b_read_before_cite, 6) < -0.02 THEN 'read_before_cite' END,
CASE WHEN t_n_steps < 3 THEN 'n_steps' END, CASE WHEN t_answer_words >= round(1.5 * greatest(1.0, b_answer_words), 6) THEN 'answer_words' END,
CASE WHEN t_n_citations >= round(1.5 * greatest(0.5, b_n_citations), 6) AND round(t_title_f1 - b_title_f1, 6) <= 0 THEN 'n_citations' END], lambda x: x IS NOT NULL), ',') AS failed FROM m""", chain=True)
def rl_gate(spark, d):
    return _both(spark, d).select("hops", F.array_join(C.rl_gate(), ",").alias("failed"))


@query(", s AS (SELECT n_steps AS step, round(avg((bucket = 'correct_and_cited')::INT::DOUBLE), 6) AS a, round(avg(correct::INT::DOUBLE), 6) AS b FROM rows GROUP BY 1) SELECT (SELECT step FROM s ORDER BY a DESC, b DESC, step LIMIT 1) AS best, (SELECT max(step) FROM s) AS latest", chain=True)
def best_checkpoint(spark, d):
    rows = _rows(spark, d).withColumn("correct_and_cited", F.col("bucket") == "correct_and_cited")
    return C.best_checkpoint(C.means_by(rows.withColumnRenamed("n_steps", "step"), "step", ["correct_and_cited", "correct"]))


@query("WITH h AS (SELECT user_id AS run, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT run, first, last, CASE WHEN last < round(first * 0.3, 9) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM h")
def overfit_verdict(spark, d):
    return C.overfit_verdict(table(spark, d, "events").select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("loss")))


# ---- validation

HISTORY = """WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, text FROM conversations WHERE conv_id % 7 <> 0),
e AS (SELECT conv_id, bool_or(conv_id % 11 = 0) AS bad, arg_min(role, k) AS first, count(*) FILTER (role = 'assistant') AS na FROM c GROUP BY conv_id),
s AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.k = a.k + 1 AND a.role = b.role),
f AS (SELECT DISTINCT conv_id, 'fail' AS severity, 'history_missing' AS key FROM conversations WHERE conv_id % 7 = 0 UNION ALL SELECT conv_id, 'fail', 'history_malformed' FROM e WHERE bad
UNION ALL SELECT conv_id, 'fail', 'history_does_not_start_with_prompt' FROM e WHERE NOT bad AND first <> 'user' UNION ALL SELECT conv_id, 'fail', 'roles_do_not_alternate' FROM e JOIN s USING (conv_id) WHERE NOT bad
UNION ALL SELECT conv_id, 'fail', 'no_assistant_turn' FROM e WHERE NOT bad AND na = 0 UNION ALL SELECT conv_id, 'warn', 'history_assistant_differs_from_raw_turns' FROM e WHERE NOT bad AND na > 0 AND conv_id % 5 = 0)"""


def _histories(spark, d):
    t = table(spark, d, "conversations")
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    content = lambda m: F.when(F.col("conv_id") % 11 != 0, F.coalesce(m["text"], F.lit("")))
    history = F.when(F.col("conv_id") % 7 != 0, F.transform("x", lambda m: F.struct(m["role"].alias("role"), content(m).alias("content"))))
    said = F.transform(F.filter("x", lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["text"], F.lit("")))
    raws = F.when(F.col("conv_id") % 5 == 0, F.transform(said, lambda x: F.concat(x, F.lit("?")))).otherwise(F.slice(said, 1, 2))
    return per.select("conv_id", history.alias("history"), raws.alias("raws"))


@query(HISTORY + " SELECT * FROM f")
def history_findings(spark, d):
    return C.history_findings(_histories(spark, d))


@query(HISTORY + " SELECT count(*) FILTER (severity = 'fail') = 0 AS passed, count(*) FILTER (severity = 'fail')::BIGINT AS n_fail, count(*) FILTER (severity = 'warn')::BIGINT AS n_warn FROM f")
def validation_verdict(spark, d):
    return C.verdict(C.history_findings(_histories(spark, d)))


SCORED = r""", sd AS (SELECT rows.ep, f1, ep % 6 = 0 AS correct, greatest(0, n_reads - ep % 3) AS n_reads, len(c) AS nc, CASE WHEN ep % 12 = 0 THEN '' ELSE trim(regexp_replace(coalesce(final_answer, ''), '\[[^\]]+?\]', '', 'g')) || CASE WHEN ep % 4 = 1 THEN ' and so on and on and on and on and on' ELSE '' END END AS bare FROM rows)"""


@query(SCORED + r""" SELECT ep, 'warn' AS severity, 'strict_keep_with_fewer_reads_than_citations' AS key FROM sd WHERE ep % 12 <> 0 AND f1 >= 0.999 AND nc > n_reads UNION ALL SELECT ep, 'fail', 'correct_but_empty_answer' FROM sd WHERE correct AND trim(bare) = ''
UNION ALL SELECT ep, 'warn', 'answer_too_long' FROM sd WHERE len(list_filter(regexp_split_to_array(bare, '\s+'), lambda x: x <> '')) > 12""", chain=True)
def scoring_findings(spark, d):
    more = F.when(F.col("ep") % 4 == 1, F.lit(" and so on and on and on and on and on")).otherwise("")
    answer = F.when(F.col("ep") % 12 == 0, "").otherwise(F.concat(F.coalesce("final_answer", F.lit("")), more))
    rows = _rows(spark, d).withColumns({"final_answer": answer, "correct": F.col("ep") % 6 == 0, "n_reads": F.greatest(F.lit(0), F.col("n_reads") - F.col("ep") % 3)})
    return C.scoring_findings(rows)


@query(r""", k AS (SELECT *, len(list_filter(regexp_split_to_array(trim(coalesce(final_answer, '')), '\s+'), lambda x: x <> '')) AS w, correct AND f1 >= 0.5 AS keep FROM rows),
p2 AS (SELECT task_id, count(*) AS n, count(*) FILTER (keep) AS m FROM k GROUP BY 1)
SELECT sum(n)::BIGINT AS episodes, count(*)::BIGINT AS questions, sum(m)::BIGINT AS kept, count(*) FILTER (m > 0)::BIGINT AS kept_questions, max(m)::BIGINT AS most_of_a_question,
  (SELECT coalesce(string_agg(w::VARCHAR, ',' ORDER BY w), '') FROM (SELECT DISTINCT w FROM k WHERE keep)) AS answer_lengths FROM p2""", chain=True)
def collection_report(spark, d):
    return C.collection_report(_rows(spark, d), 0.5).withColumn("answer_lengths", F.array_join(F.transform("answer_lengths", lambda x: x.cast("string")), ","))


# ---- choosing and counting

TIER = "CASE WHEN ep % 7 = 0 THEN 'drop_api' WHEN ep % 11 = 0 THEN 'drop_nohistory' WHEN correct AND f1 >= 0.999 THEN 'A' WHEN len(list_filter(list_distinct(gold), lambda x: list_contains(rd, x)))::DOUBLE / greatest(len(list_distinct(gold)), 1) >= 0.5 THEN 'B' ELSE 'C' END"


@query(f", tr AS (SELECT {TIER} AS tier FROM rows) SELECT tier, count(*)::BIGINT AS n FROM tr GROUP BY tier", chain=True)
def tier_counts(spark, d):
    return tier_rows(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(f", tr AS (SELECT ep, correct, CASE WHEN ep % 3 = 0 THEN CASE WHEN correct THEN 'P' ELSE 'P_wrong' END ELSE {TIER} END AS path FROM rows) SELECT ep, path FROM tr WHERE path IN ('A', 'B', 'P')", chain=True)
def tier_members(spark, d):
    rows = tier_rows(spark, d).join(_rows(spark, d).select("ep", "correct"), "ep")
    return C.members(rows, ("A", "B", "P"), F.col("ep") % 3 == 0).select("ep", "path")


@query("SELECT item_id, unnest(range(4))::INT AS sample FROM benchmark")
def replicate_tasks(spark, d):
    return C.replicate(table(spark, d, "benchmark").select("item_id"), 4)


@query("SELECT ep, task_id, final_answer FROM rows ORDER BY ep LIMIT 5 OFFSET 3", chain=True)
def sample_rows(spark, d):
    return C.part(_rows(spark, d), "ep", 5, 3).select("ep", "task_id", "final_answer")


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)) SELECT doc_id, CASE WHEN k <= greatest(1, (n * 0.05)::INT) THEN 'val' ELSE 'train' END AS split FROM o")
def split_fraction(spark, d):
    return C.split_fraction(table(spark, d, "documents"), "doc_id", 0.05)


@query(", o AS (SELECT ep, task_id, CASE WHEN n_tool_calls <= 1 THEN 0 WHEN correct THEN 1 ELSE 2 END AS ord FROM rows) SELECT ep, task_id, ord::INT AS ord FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ord, ep) = 1) ORDER BY ord, ep LIMIT 12", chain=True)
def picked_spread(spark, d):
    # an episode with a single call counts as one without here, so that each kind occurs
    return C.spread(_rows(spark, d).withColumn("n_tool_calls", F.greatest(F.lit(0), F.col("n_tool_calls") - 1)), 12).select("ep", "task_id", F.col("order").alias("ord"))


@query(" SELECT arm, coalesce(round(avg(CASE WHEN n_reads > 0 THEN answer_words::DOUBLE END), 6), 0)::DOUBLE AS words_of_readers, coalesce(round(avg(CASE WHEN n_steps > 99 THEN 1.0::DOUBLE END), 6), 0)::DOUBLE AS none FROM rows GROUP BY arm", chain=True)
def conditional_means(spark, d):
    return _rows(spark, d).groupBy("arm").agg(C.mean_where("answer_words", F.col("n_reads") > 0).alias("words_of_readers"), C.mean_where("n_steps", F.col("n_steps") > 99).alias("none"))


SWEEP = ["correct", "f1", "n_steps"]


@query(" SELECT round(0.2 * hops, 1)::DOUBLE AS temperature, count(*)::BIGINT AS n, round(avg(correct::INT::DOUBLE), 6) AS correct, round(avg(f1), 6) AS f1, round(avg(n_steps::DOUBLE), 6) AS n_steps FROM rows GROUP BY 1", chain=True)
def temperature_sweep(spark, d):
    return C.means_by(_rows(spark, d).withColumn("temperature", F.round(F.lit(0.2) * F.col("hops"), 1)), "temperature", SWEEP)


@query(" SELECT n_tool_calls >= 4 AS capped, count(*)::BIGINT AS n, round(avg(correct::INT::DOUBLE), 6) AS correct, round(avg(done::INT::DOUBLE), 6) AS done FROM rows GROUP BY 1", chain=True)
def capped_by_finished(spark, d):
    return C.means_by(_rows(spark, d).withColumn("capped", F.col("n_tool_calls") >= 4), "capped", ["correct", "done"])


@query("WITH g AS (SELECT o_custkey AS grp, CASE WHEN o_totalprice > 150000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM orders), s AS (SELECT stddev_pop(reward) AS s FROM g GROUP BY grp) SELECT count(*)::BIGINT AS groups, count(*) FILTER (s = 0)::BIGINT AS flat, round(median(s), 6) AS median_std FROM s")
def group_spread(spark, d):
    return C.group_spread(_groups(spark, d))


@query(f""", {G.READ}, cs AS (SELECT CASE WHEN body <> '' THEN CASE WHEN NOT readable THEN 'malformed_json_in_tool_call' WHEN fname IN ('search', 'read', 'answer') THEN 'parsed_ok' ELSE 'unknown_tool:' || fname END
  WHEN contains(reply, '<tool_call>') THEN 'tool_call_unclosed(stop=None)' ELSE 'plain_prose_no_tool_call' END AS cause FROM nl)
SELECT cause, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM cs GROUP BY cause""", chain=True)
def cause_shares(spark, d):
    from tessera.operators.evaluation import share

    ev = views._events(spark, d).selectExpr(f"{G.REPLY} AS text")
    return share(ev.select(N.native_cause(F.col("text"), F.lit("stop"), F.lit(None).cast("string")).alias("cause")), "cause")


@query("WITH r AS (SELECT count(*)::DOUBLE AS n, round(avg(value), 6) AS mean, max(value) AS top FROM events) SELECT unnest(['n', 'mean', 'top']) AS key, unnest([n, mean, top]) AS value FROM r")
def report_scalars(spark, d):
    return C.scalars(table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top")))


@query(" SELECT ep, correct, bucket, ep % 9 = 0 AS api_gave_up, CASE WHEN ep % 9 <> 0 THEN n_steps END AS n_raws FROM rows", chain=True)
def collected_records(spark, d):
    rows = _rows(spark, d)
    raws = rows.filter("ep % 9 <> 0").select("ep", F.transform("steps", lambda s: s["obs"]).alias("raw_turns"), F.lit(False).alias("api_gave_up"))
    return C.collected(rows.select("ep", "correct", "bucket"), raws).select("ep", "correct", "bucket", "api_gave_up", F.when(~F.col("api_gave_up"), F.size("raw_turns")).alias("n_raws"))


@query("SELECT o_orderkey AS step, o_totalprice::DOUBLE AS em FROM orders ORDER BY em DESC, step LIMIT 4")
def checkpoints_by_em(spark, d):
    return C.top_checkpoints(table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").cast("double").alias("em")), 4)
