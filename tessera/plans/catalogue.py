"""Named queries over the driver tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import datasets as D
from tessera.operators import episode as E
from tessera.operators import evaluation as V
from tessera.operators import containment as C
from tessera.operators import overlap as O
from tessera.operators import ranking as K
from tessera.operators import retrieval as R
from tessera.operators import rewards as W
from tessera.plans import views
from tessera.plans.views import CHAIN, table
from tessera.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, chain: bool = False):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (CHAIN if chain else "") + sql
        return f

    return put


# ---- inputs


def _corpus(spark, d):
    return table(spark, d, "documents").selectExpr("0 AS task_id", "doc_id AS pos", "concat('doc ', doc_id) AS title", "text")


def _items(spark, d):
    """Benchmark texts as questions."""
    return table(spark, d, "benchmark").selectExpr("item_id AS qid", "text AS query")


def _steps(spark, d):
    return E.fold(views.turns(spark, d), views.tools(spark, d))


def _episodes(spark, d):
    return E.assemble(_steps(spark, d), views.tasks(spark, d))


def _rows(spark, d):
    eps = _episodes(spark, d).withColumn("hit_rate", E.hit_rate(F.col("gold"), F.col("retrieved")))
    return E.eval_rows(eps, E.citation_report(eps))


BM25 = r"""
WITH docs AS (SELECT 'doc ' || doc_id AS title, regexp_extract_all(lower('doc ' || doc_id || ' ' || coalesce(text, '')), '[a-z0-9]+') AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
tok AS (SELECT title, len(toks) AS dl, unnest(toks) AS token FROM docs),
post AS (SELECT title, dl, token, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qt AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM benchmark),
qq AS (SELECT qid, token, count(*) AS qtf FROM qt GROUP BY ALL),
sc AS (SELECT qid, title, round(sum(qtf * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qq JOIN df USING (token) JOIN post USING (token), st GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, title) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 3)
"""


# ---- retrieval


@query(BM25 + "SELECT qid, title, score, rank::INT AS rank FROM top")
def bm25_topk(spark, d):
    return K.search_corpus(_items(spark, d), _corpus(spark, d)).select("qid", "title", "score", "rank")


@query(BM25 + "SELECT count(*)::BIGINT AS n_postings, sum(tf)::BIGINT AS n_tokens, (SELECT n FROM st)::BIGINT AS n_docs, (SELECT round(avgdl, 6) FROM st) AS avgdl FROM post")
def bm25_index_stats(spark, d):
    postings, stats = R.index(_corpus(spark, d))
    return postings.agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens")).crossJoin(stats.select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl")))


@query(BM25 + """, gold AS (SELECT item_id AS qid, 'doc ' || doc_id AS title FROM benchmark b JOIN documents t ON contains(t.text, b.text)),
g AS (SELECT qid, count(*) AS n_gold, count(top.title) AS n_hit FROM gold LEFT JOIN top USING (qid, title) GROUP BY qid)
SELECT item_id AS qid, coalesce(n_gold, 0)::BIGINT AS n_gold, CASE WHEN n_gold > 0 THEN round(n_hit::DOUBLE / n_gold, 6) ELSE 1.0 END AS hit_rate FROM benchmark LEFT JOIN g ON qid = item_id""")
def bm25_hit_rate(spark, d):
    b = table(spark, d, "benchmark")
    gold = C.containing(table(spark, d, "documents").selectExpr("concat('doc ', doc_id) AS title", "text"), b.selectExpr("item_id AS qid", "text AS held"))
    top = K.search_corpus(_items(spark, d), _corpus(spark, d)).select("qid", "title", F.lit(1).alias("hit"))
    g = gold.join(top, ["qid", "title"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_hit"))
    return b.selectExpr("item_id AS qid").join(g, "qid", "left").select("qid", F.coalesce("n_gold", F.lit(0)).cast("long").alias("n_gold"), F.when(F.col("n_gold") > 0, F.round(F.col("n_hit") / F.col("n_gold"), 6)).otherwise(1.0).alias("hit_rate"))


PASSAGES = "SELECT doc_id // 10 AS task_id, doc_id % 10 AS pos, CASE WHEN doc_id % 2 = 0 THEN lang ELSE upper(lang) END AS title, text FROM documents"


def _passages(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id div 10 AS task_id", "doc_id % 10 AS pos", "CASE WHEN doc_id % 2 = 0 THEN lang ELSE upper(lang) END AS title", "text")


@query(f"WITH p AS ({PASSAGES}), r AS (SELECT *, row_number() OVER (PARTITION BY task_id, title ORDER BY pos) AS k FROM p) SELECT task_id, pos, CASE WHEN k > 1 THEN title || ' (' || k || ')' ELSE title END AS title FROM r")
def dedupe_title_suffix(spark, d):
    return R.suffix_repeated_titles(_passages(spark, d).drop("text"))


@query(f"WITH p AS ({PASSAGES}) SELECT task_id, title, pos FROM p QUALIFY row_number() OVER (PARTITION BY task_id, title ORDER BY pos DESC) = 1")
def last_passage_of_title(spark, d):
    return R.last_of_title(_passages(spark, d).drop("text")).select("task_id", "title", "pos")


@query(f"""WITH p AS (SELECT DISTINCT task_id, title FROM ({PASSAGES})), a AS (SELECT task_id, unnest(['en', 'De ', 'FR', 'xx']) AS asked FROM (SELECT DISTINCT task_id FROM p)),
l AS (SELECT task_id, lower(title) AS low, min(title) AS loose FROM p GROUP BY ALL HAVING count(*) = 1)
SELECT a.task_id, a.asked, coalesce(p.title, l.loose) AS title FROM a LEFT JOIN p ON p.task_id = a.task_id AND p.title = a.asked LEFT JOIN l ON l.task_id = a.task_id AND l.low = lower(trim(a.asked))""")
def read_by_title_exact_or_unique_ci(spark, d):
    p = _passages(spark, d)
    asked = p.select("task_id").distinct().withColumn("asked", F.explode(F.array(*map(F.lit, ["en", "De ", "FR", "xx"]))))
    return R.read_by_title(asked, p)


@query(r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE rtrim(substring(f, 1, 240)) || '…' END AS snippet FROM t")
def snippet_projection(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query(BM25 + "SELECT qid, 'search results:' || chr(10) || string_agg('[' || rank || '] ' || top.title, chr(10) ORDER BY rank) AS obs FROM top GROUP BY qid")
def search_observation_text(spark, d):
    top = K.search_corpus(_items(spark, d), _corpus(spark, d)).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("x"))
    return top.select("qid", F.concat(F.lit("search results:\n"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["title"])), "\n")).alias("obs"))


# ---- text

NORM = r"""list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"""
#: Every document with the benchmark text that BM25 ranks first for it, both whole; pred is null where no token is shared.
BEST = r"""
WITH items AS (SELECT item_id, 'item ' || item_id AS title, regexp_extract_all(lower('item ' || item_id || ' ' || coalesce(text, '')), '[a-z0-9]+') AS toks FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM items),
tok AS (SELECT item_id, title, len(toks) AS dl, unnest(toks) AS token FROM items),
post AS (SELECT item_id, title, dl, token, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qq AS (SELECT doc_id, token, count(*) AS qtf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL),
sc AS (SELECT doc_id, item_id, title, round(sum(qtf * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qq JOIN df USING (token) JOIN post USING (token), st GROUP BY ALL),
best AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, title) = 1),
pairs AS (SELECT d.doc_id, best.item_id, b.text AS pred, d.text AS gold FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN benchmark b ON b.item_id = best.item_id)
"""


def _pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("gold"))
    items = table(spark, d, "benchmark").selectExpr("item_id", "concat('item ', item_id) AS title", "text")
    best = K.with_best_passage(docs, "doc_id", "gold", items)
    return best.join(items.select("item_id", "title", F.col("text").alias("pred")), "title", "left").select("doc_id", "item_id", "pred", "gold")


def _over(spark, d, tokens, measure, name):
    """A measure of the tokens that a document and its best benchmark text share."""
    p = _pairs(spark, d).select("doc_id", "item_id", tokens(F.col("pred")).alias("a"), tokens(F.coalesce("gold", F.lit(""))).alias("b"))
    over = O.overlaps(p, "doc_id", "item_id")
    return over.select("doc_id", "item_id", F.round(measure(over), 6).alias(name))


@query(f"SELECT doc_id, array_to_string({NORM.format('text')}, ' ') AS norm FROM documents")
def normalize_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_answer(F.col("text")).alias("norm"))


@query(BEST + f"SELECT doc_id, item_id, {NORM.format('pred')} = {NORM.format('gold')} AS em, {NORM.format('gold')} = {NORM.format("('The ' || coalesce(gold, ''))")} AS em_self FROM pairs")
def exact_match(spark, d):
    gold = F.coalesce("gold", F.lit(""))
    return _pairs(spark, d).select("doc_id", "item_id", X.exact_match(F.col("pred"), F.array(gold)).alias("em"), X.exact_match(gold, F.array(F.concat(F.lit("The "), gold))).alias("em_self"))


#: Of a pair: lengths, and counts of each token on either side.
_COUNTED = """, w AS (SELECT doc_id, item_id, {a} AS a, {b} AS b FROM pairs),
c AS (SELECT doc_id, t, sum(x) AS x, sum(y) AS y FROM (SELECT doc_id, unnest(a) AS t, 1 AS x, 0 AS y FROM w UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM w) GROUP BY ALL),
o AS (SELECT doc_id, sum(least(x, y)) AS same, sum(CASE WHEN y > 0 THEN x ELSE 0 END) AS in_b FROM c GROUP BY doc_id)
"""
_NORMAL = _COUNTED.format(a=NORM.format("pred"), b=NORM.format("gold"))


@query(BEST + _NORMAL + "SELECT doc_id, item_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2 * coalesce(same, 0)::DOUBLE / (len(a) + len(b)) END, 6)::DOUBLE AS f1 FROM w LEFT JOIN o USING (doc_id)")
def token_f1(spark, d):
    return _over(spark, d, X.answer_tokens, O.f1, "f1")


@query(BEST + _NORMAL + "SELECT doc_id, item_id, round(coalesce(in_b, 0)::DOUBLE / greatest(len(a), 1), 6) AS recall FROM w LEFT JOIN o USING (doc_id)")
def answer_recall(spark, d):
    return _over(spark, d, X.answer_tokens, O.recall, "recall")


@query(BEST + _COUNTED.format(a="regexp_extract_all(lower(coalesce(pred, '')), '[a-z0-9]+')", b="regexp_extract_all(lower(coalesce(gold, '')), '[a-z0-9]+')") + "SELECT doc_id, item_id, round(coalesce(in_b, 0)::DOUBLE / greatest(len(a), 1), 6) AS score FROM w LEFT JOIN o USING (doc_id)")
def citation_alignment_overlap(spark, d):
    return _over(spark, d, X.bm25_tokens, O.recall, "score")


@query("SELECT ep, t, name, payload, parse_ok FROM (SELECT ep, t, CASE WHEN hit THEN act END AS name, CASE WHEN hit THEN payload END AS payload, hit AS parse_ok FROM p)", chain=True)
def parse_action(spark, d):
    return views.turns(spark, d).withColumn("a", X.parse_action(F.col("text"))).select("ep", "t", "a.name", "a.payload", "a.parse_ok")


CALLS = "CASE WHEN event_id % 4 = 0 THEN 'no call' WHEN event_id % 4 = 1 THEN '<tool_call>{\"name\": \"search\", \"arguments\": {\"query\": \"q' || event_id || '\"}}</tool_call>' WHEN event_id % 4 = 2 THEN 'x <tool_call> {\"name\": \"read\", \"arguments\": \"{\\\\\"query\\\\\": \\\\\"r\\\\\"}\"} </tool_call>' ELSE '<tool_call>{\"name\": \"read\"}</tool_call>' END"


@query(f"""WITH c AS (SELECT event_id, regexp_extract({CALLS.replace(chr(92) * 2, chr(92))}, '(?s)<tool_call>\\s*(\\{{.*?\\}})\\s*</tool_call>', 1) AS body FROM events),
j AS (SELECT event_id, CASE WHEN body <> '' THEN body::JSON ->> '$.name' END AS name, CASE WHEN body <> '' THEN body::JSON ->> '$.arguments' END AS args FROM c)
SELECT event_id, name, CASE WHEN args IS NOT NULL THEN args::JSON ->> '$.query' END AS query, name IS NOT NULL AND args IS NOT NULL AS ok FROM j""")
def parse_native_call(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{CALLS} AS text").withColumn("c", X.parse_native_call(F.col("text"))).select("event_id", "c.name", F.col("c.arguments")["query"].alias("query"), "c.ok")


@query(r"SELECT ep, t, regexp_extract(text || chr(10) || 'Thought: more', '(?s)^(.*?)\n(?:Thought:|search results:|\[)', 1) AS cut FROM raw", chain=True)
def turn_stop_cut(spark, d):
    return views.turns(spark, d).select("ep", "t", X.turn_stop_cut(F.concat("text", F.lit("\nThought: more"))).alias("cut"))


@query(r"SELECT event_id, greatest(0.0::DOUBLE, least(10.0::DOUBLE, coalesce(try_cast(nullif(regexp_extract(s, '\d+(?:\.\d+)?'), '') AS DOUBLE), 0))) AS score FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'score: ' || (event_id % 17) || '.5/10' END AS s FROM events)")
def parse_judge_score(spark, d):
    s = F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.concat(F.lit("score: "), (F.col("event_id") % 17).cast("string"), F.lit(".5/10")))
    return table(spark, d, "events").select("event_id", X.parse_judge_score(s).alias("score"))


# ---- episodes


@query("SELECT ep, t, name, payload, parse_ok, ok, error, obs, array_to_string(titles, ',') AS titles FROM steps", chain=True)
def episode_fold(spark, d):
    return _steps(spark, d).select("ep", "t", "name", "payload", "parse_ok", "ok", "error", "obs", F.array_join("titles", ",").alias("titles"))


@query("SELECT ep, task_id, done, final_answer, n_steps, n_tool_calls, n_searches, n_reads, n_bad, array_to_string(list_sort(retrieved), ',') AS retrieved FROM eps", chain=True)
def trajectory_assemble(spark, d):
    return _episodes(spark, d).select("ep", "task_id", "done", "final_answer", "n_steps", "n_tool_calls", "n_searches", "n_reads", "n_bad", F.array_join(F.array_sort("retrieved"), ",").alias("retrieved"))


@query("SELECT ep, round(hit_rate, 6) AS hit_rate FROM rows", chain=True)
def retrieval_hit_rate(spark, d):
    return _rows(spark, d).select("ep", F.round("hit_rate", 6).alias("hit_rate"))


@query("SELECT ep, lower(titles[1]) AS norm_title, arg_max(regexp_replace(obs, '(?s)^\\[.*?\\]\\n', ''), t) AS body FROM steps WHERE name = 'read' AND ok GROUP BY ALL", chain=True)
def evidence_map(spark, d):
    return E.evidence(_steps(spark, d))


@query("SELECT ep, x AS title FROM (SELECT ep, unnest(flatten(list(ts))) AS x FROM sc GROUP BY ep)", chain=True)
def extract_citations(spark, d):
    return _episodes(spark, d).select("ep", F.explode(X.citations(F.col("final_answer"))).alias("c")).select("ep", "c.title")


@query(r"SELECT ep, trim(regexp_replace(final_answer, '\[[^\]]+?\]', '', 'g')) AS bare, n_uncited FROM rep WHERE done", chain=True)
def strip_citations(spark, d):
    return _episodes(spark, d).filter("done").select("ep", X.strip_citations(F.col("final_answer")).alias("bare"), X.uncited_claims(F.col("final_answer")).alias("n_uncited"))


REPORT = ["ep", "n_citations", "n_resolved", "n_fabricated", "tp", "fp", "fn", "n_uncited"]
RATIOS = ["precision", "recall", "f1", "title_precision", "title_recall", "title_f1", "read_before_cite"]


@query(f"SELECT {', '.join(REPORT)}, " + ", ".join(f'round("{c}", 6)::DOUBLE AS "{c}"' for c in RATIOS) + " FROM rep", chain=True)
def citation_report(spark, d):
    return E.citation_report(_episodes(spark, d)).select(*REPORT, *[F.round(c, 6).alias(c) for c in RATIOS])


@query("SELECT ep, round(format_error, 6) AS format_error FROM rows", chain=True)
def format_error(spark, d):
    return _rows(spark, d).select("ep", F.round("format_error", 6).alias("format_error"))


TOLL = "(0.25 * n_fabricated + 0.1 * format_error)"


def _reward(mode: str, core: str) -> None:
    def run(spark, d):
        rows = _rows(spark, d)
        return rows.select("ep", F.round(W.reward(rows, mode)[0], 6).alias("reward"))

    run.__name__ = f"reward_{mode}"
    query(f"SELECT ep, round({core} - {TOLL}, 6) AS reward FROM rows", chain=True)(run)


_reward("gated", "outcome * (0.5 + 0.5 * f1)")
_reward("additive", "(outcome + 0.5 * f1)")
_reward("cite_gated", "(CASE WHEN n_citations > 0 THEN outcome * (0.5 + 0.5 * f1) ELSE 0 END)")


@query("SELECT event_id, CASE WHEN event_id <= 60 THEN 0.0 WHEN event_id >= 200 THEN 0.02 ELSE round((event_id - 60) / 140.0::DOUBLE * 0.02, 8) END::DOUBLE AS toll, CASE WHEN event_id <= 20 THEN 0.5 WHEN event_id >= 120 THEN 0.15 ELSE round(0.5 + (event_id - 20) / 100.0::DOUBLE * (0.15 - 0.5), 8) END::DOUBLE AS beta FROM events")
def reward_ramps(spark, d):
    s = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(X.ramp(s, 60, 200, 0.0, 0.02), 8).alias("toll"), F.round(X.ramp(s, 20, 120, 0.5, 0.15), 8).alias("beta"))


@query("SELECT ep, round(least(1.0, CASE WHEN done AND final_answer <> '' THEN 0.4 ELSE 0 END + CASE WHEN len(retrieved) > 0 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(final_answer, '') <> '' THEN 0.3 ELSE 0 END), 6)::DOUBLE AS score FROM rows", chain=True)
def mock_judge(spark, d):
    given = F.coalesce("final_answer", F.lit("")) != ""
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    return _episodes(spark, d).select("ep", F.round(F.least(F.lit(1.0), part(F.col("done") & given, 0.4) + part(F.size("retrieved") > 0, 0.3) + part(given, 0.3)), 6).alias("score"))


# ---- evaluation


@query("SELECT ep, bucket, correct, capped, answer_words FROM rows", chain=True)
def outcome_buckets(spark, d):
    return _rows(spark, d).select("ep", "bucket", "correct", "capped", "answer_words")


@query("SELECT bucket, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM rows GROUP BY bucket", chain=True)
def bucket_pct(spark, d):
    return V.share(_rows(spark, d), "bucket")


@query("SELECT n_tool_calls, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM rows GROUP BY n_tool_calls", chain=True)
def hop_histogram(spark, d):
    return V.share(_rows(spark, d), "n_tool_calls")


SUMMARY = ["correct", "done", "capped", "f1", "title_f1", "read_before_cite", "n_reads", "n_searches", "n_citations", "answer_words"]


@query("SELECT count(*)::BIGINT AS n, " + ", ".join(f"round(avg({c}::INT::DOUBLE), 6) AS {c}" if c in ("correct", "done", "capped") else f"round(avg({c}::DOUBLE), 6) AS {c}" for c in SUMMARY) + " FROM rows", chain=True)
def classifier_summary(spark, d):
    return V.aggregate(_rows(spark, d).select(*SUMMARY))


@query("SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN event_id % 3 = 0 THEN value END), 6) AS value, round(avg((event_id % 2 = 0)::INT::DOUBLE), 6) AS even FROM events")
def aggregate_skip_missing(spark, d):
    return V.aggregate(table(spark, d, "events").selectExpr("CASE WHEN event_id % 3 = 0 THEN value END AS value", "event_id % 2 = 0 AS even"))


@query("""SELECT CASE WHEN grouping(arm) = 0 THEN 'arm' WHEN grouping(hops) = 0 THEN 'hops' ELSE 'all' END AS slice, coalesce(arm, hops::VARCHAR, '') AS value, count(*)::BIGINT AS n, round(avg(correct::INT::DOUBLE), 6) AS correct,
round(avg(f1), 6) AS f1, round(avg((bucket = 'correct_and_cited')::INT::DOUBLE), 6) AS good, round(avg(capped::INT::DOUBLE), 6) AS capped FROM rows GROUP BY GROUPING SETS ((arm), (hops), ())""", chain=True)
def slice_by_dataset_hops(spark, d):
    return V.slices(_rows(spark, d), "arm", "hops")


@query("""SELECT m AS measure, round(avg(CASE WHEN arm = 'base' THEN v END), 6) AS base, round(avg(CASE WHEN arm = 'tuned' THEN v END), 6) AS tuned,
round(round(avg(CASE WHEN arm = 'tuned' THEN v END), 6) - round(avg(CASE WHEN arm = 'base' THEN v END), 6), 6) AS delta_tuned
FROM (SELECT arm, unnest(['correct', 'f1', 'n_steps']) AS m, unnest([correct::INT::DOUBLE, f1, n_steps::DOUBLE]) AS v FROM rows) GROUP BY m""", chain=True)
def arm_pivot_delta(spark, d):
    return V.pivot_arms(_rows(spark, d), ["base", "tuned"], ["correct", "f1", "n_steps"])


PAIRED = ", a AS (SELECT task_id, bool_or(correct) AS x FROM rows WHERE arm = 'base' GROUP BY task_id), b AS (SELECT task_id, bool_or(correct) AS y FROM rows WHERE arm = 'tuned' GROUP BY task_id)"


def _arms(spark, d):
    rows = _rows(spark, d)
    one = lambda arm: rows.filter(F.col("arm") == arm).groupBy("task_id").agg(F.bool_or("correct").alias("correct"))
    return one("base"), one("tuned")


@query(PAIRED + "SELECT count(*) FILTER (x AND y)::BIGINT AS \"both\", count(*) FILTER (x AND NOT y)::BIGINT AS only_a, count(*) FILTER (NOT x AND y)::BIGINT AS only_b, count(*) FILTER (NOT x AND NOT y)::BIGINT AS neither FROM a JOIN b USING (task_id)", chain=True)
def paired_outcomes(spark, d):
    return V.paired(*_arms(spark, d))


ARM = ", s AS (SELECT arm, round(avg(correct::INT::DOUBLE), 6) AS em, round(avg(f1), 6) AS f1, round(avg(hit_rate), 6) AS hit_rate, round(avg(n_steps::DOUBLE), 6) AS n_steps, round(avg(n_fabricated::DOUBLE), 6) AS fabricated, round(avg(answer_words::DOUBLE), 6) AS words FROM rows GROUP BY arm), b AS (SELECT * FROM s WHERE arm = 'base'), t AS (SELECT * FROM s WHERE arm = 'tuned')"
PROBES = """list_filter([CASE WHEN t.em > b.em + 0.02 AND t.hit_rate <= b.hit_rate + 0.01 THEN 'MEMORY-GUESSING' END, CASE WHEN t.n_steps < 1.5 THEN 'TOOL-AVOIDANCE' END, CASE WHEN t.fabricated > b.fabricated + 0.05 THEN 'FABRICATION' END,
CASE WHEN t.words > 1.5 * b.words AND t.f1 <= b.f1 + 0.02 THEN 'LENGTH-INFLATION' END], lambda x: x IS NOT NULL)"""


def _summaries(spark, d):
    rows = _rows(spark, d)
    s = rows.groupBy("arm").agg(V.mean("correct", "em"), V.mean("f1"), V.mean("hit_rate"), V.mean("n_steps"), V.mean("n_fabricated", "fabricated"), V.mean("answer_words", "words"))
    return s.filter("arm = 'base'").drop("arm"), s.filter("arm = 'tuned'").drop("arm")


@query(ARM + f"SELECT array_to_string({PROBES}, '; ') AS probes FROM b, t", chain=True)
def eval_probes(spark, d):
    return V.probes(*_summaries(spark, d)).select(F.array_join("probes", "; ").alias("probes"))


@query(ARM + f", g AS (SELECT list_concat(list_filter([CASE WHEN t.em - b.em < 0.05 THEN 'em gain' END, CASE WHEN t.f1 < b.f1 - 0.02 THEN 'f1 loss' END], lambda x: x IS NOT NULL), {PROBES}) AS r FROM b, t) SELECT len(r) = 0 AS passed, array_to_string(r, '; ') AS reasons FROM g", chain=True)
def eval_gate(spark, d):
    return V.gate(*_summaries(spark, d))


@query(PAIRED + """, pz AS (SELECT row_number() OVER (ORDER BY task_id) - 1 AS i, y::INT::DOUBLE - x::INT::DOUBLE AS d FROM a JOIN b USING (task_id)),
n AS (SELECT count(*) AS n FROM pz), dr AS (SELECT r.b, (r.b * 7919 + pz.i * 104729 + r.b * pz.i * 31) % n.n AS i FROM range(200) r(b), pz, n),
m AS (SELECT b, round(avg(d), 6) AS m FROM dr JOIN pz USING (i) GROUP BY b), o AS (SELECT list(m ORDER BY m) AS l FROM m)
SELECT (SELECT round(avg(d), 6) FROM pz) AS delta, l[floor(200 * 0.025)::INT + 1] AS low, l[floor(200 * 0.975)::INT + 1] AS high FROM o""", chain=True)
def bootstrap_ci(spark, d):
    from pyspark.sql import Window

    a, b = _arms(spark, d)
    both = a.withColumnRenamed("correct", "x").join(b.withColumnRenamed("correct", "y"), "task_id")
    return V.bootstrap(both.select((F.row_number().over(Window.orderBy("task_id")) - 1).cast("long").alias("i"), (F.col("y").cast("double") - F.col("x").cast("double")).alias("d")))


@query("WITH l AS (SELECT list(value ORDER BY value) AS l FROM events) SELECT q, l[floor(len(l) * q)::INT + 1] AS value FROM l, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) v(q)")
def index_quantiles(spark, d):
    return V.index_quantile(table(spark, d, "events"), "value", [0.5, 0.9])


GROUPS = "SELECT o_custkey AS grp, o_orderkey AS id, CASE WHEN o_totalprice > 150000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM orders"


def _groups(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey AS grp", "o_orderkey AS id", "CASE WHEN o_totalprice > 150000 THEN 1.0D ELSE 0.0D END AS reward")


@query(f"SELECT *, round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6), 6) AS advantage FROM ({GROUPS}) WINDOW w AS (PARTITION BY grp)")
def group_advantage(spark, d):
    return V.group_advantage(_groups(spark, d))


@query(f"WITH g AS (SELECT grp, bool_and(reward > 0) AS a, bool_and(reward <= 0) AS n, min(reward) = max(reward) AS f FROM ({GROUPS}) GROUP BY grp) SELECT round(avg(a::INT::DOUBLE), 6) AS solve_all, round(avg(n::INT::DOUBLE), 6) AS solve_none, round(avg(f::INT::DOUBLE), 6) AS zero_variance, count(*)::BIGINT AS groups FROM g")
def dead_groups(spark, d):
    return V.group_health(_groups(spark, d))


@query("SELECT o_custkey AS step, o_orderkey AS em FROM (SELECT * FROM orders) QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_checkpoints(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).selectExpr("o_custkey AS step", "o_orderkey AS em")


@query("SELECT l_returnflag AS part, round(sum(l_discount * l_quantity) / greatest(1, sum(l_quantity)), 6)::DOUBLE AS loss FROM lineitem GROUP BY l_returnflag")
def token_weighted_loss(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("part")).agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.greatest(F.lit(1), F.sum("l_quantity")), 6).cast("double").alias("loss"))


# ---- data sets


@query("SELECT ep, CASE WHEN ep % 7 = 0 THEN 'drop_api' WHEN ep % 11 = 0 THEN 'drop_nohistory' WHEN correct AND f1 >= 0.999 THEN 'A' WHEN len(list_filter(list_distinct(gold), lambda x: list_contains(rd, x)))::DOUBLE / greatest(len(list_distinct(gold)), 1) >= 0.5 THEN 'B' ELSE 'C' END AS tier FROM rows", chain=True)
def tiers(spark, d):
    read = F.flatten(F.transform(F.filter("steps", lambda s: (s["name"] == "read") & s["ok"]), lambda s: s["titles"]))
    return _rows(spark, d).select("ep", D.tier(F.col("correct"), F.col("f1"), F.col("ep") % 7 == 0, F.col("ep") % 11 != 0, F.array_distinct("gold"), read).alias("tier"))


@query("SELECT ep, correct FROM rows WHERE done AND n_citations > 0 AND read_before_cite >= 0.999", chain=True)
def process_clean(spark, d):
    return D.process_clean(_rows(spark, d)).select("ep", "correct")


@query("SELECT bar, count(*) FILTER (f1 >= bar)::BIGINT AS n, count(DISTINCT CASE WHEN f1 >= bar THEN task_id END)::BIGINT AS questions FROM rows, (VALUES (0.999::DOUBLE), (0.75), (0.5), (0.34)) v(bar) GROUP BY bar", chain=True)
def yield_by_bar(spark, d):
    return D.yield_by_bar(_rows(spark, d))


@query("SELECT task_id, count(*) FILTER (done)::BIGINT AS n FROM rows GROUP BY task_id HAVING count(*) FILTER (done) < 4 ORDER BY task_id LIMIT 20", chain=True)
def resume_todo(spark, d):
    rows = _rows(spark, d)
    return D.todo(rows.select("task_id").distinct(), rows.filter("done"), 4, 20).withColumn("n", F.col("n").cast("long"))


RANGES = {"train": (0, 100), "dev": (100, 150), "test": (150, 200)}
DRAW = "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS place FROM documents), s AS (SELECT doc_id, place::INT AS place, CASE WHEN place < 100 THEN 'train' WHEN place < 150 THEN 'dev' ELSE 'test' END AS split FROM o WHERE place < 200)"


@query(DRAW + " SELECT * FROM s")
def split_ranges(spark, d):
    return D.index_ranges(table(spark, d, "documents"), "doc_id", RANGES)


@query(DRAW + " SELECT split, count(DISTINCT doc_id)::BIGINT AS n FROM s GROUP BY split")
def split_counts(spark, d):
    return split_ranges(spark, d).groupBy("split").agg(F.count_distinct("doc_id").alias("n"))


@query(DRAW + ", t AS (SELECT doc_id, split FROM s UNION ALL SELECT doc_id, 'extra' FROM s WHERE place % 10 = 0) SELECT doc_id, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM t GROUP BY doc_id HAVING count(DISTINCT split) > 1")
def split_leak_check(spark, d):
    s = split_ranges(spark, d)
    both = s.select("doc_id", "split").unionByName(s.filter("place % 10 = 0").select("doc_id", F.lit("extra").alias("split")))
    return D.leaks(both, "doc_id").select("doc_id", F.array_join("splits", ",").alias("splits"))


FIND = """WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
c AS (SELECT conv_id, max(CASE WHEN rn = 1 THEN role END) AS first, max((role = prev)::INT) AS same, count(*) FILTER (role = 'assistant') AS na, arg_max(role, turn) AS last FROM t GROUP BY conv_id),
f AS (SELECT conv_id, 'fail' AS severity, 'not_user_first' AS key FROM c WHERE first <> 'user' UNION ALL SELECT conv_id, 'fail', 'roles_do_not_alternate' FROM c WHERE same = 1
UNION ALL SELECT conv_id, 'fail', 'no_assistant_turn' FROM c WHERE na = 0 UNION ALL SELECT conv_id, 'warn', 'ends_on_user' FROM c WHERE last = 'user')"""


@query(FIND + " SELECT * FROM f")
def structure_findings(spark, d):
    return D.structure_findings(table(spark, d, "conversations"))


@query(FIND + " SELECT severity, key, count(*)::BIGINT AS n, min(conv_id) AS example FROM f GROUP BY severity, key")
def findings_report(spark, d):
    return D.findings_report(D.structure_findings(table(spark, d, "conversations")))


MASK = r"""WITH a AS (SELECT *, role = 'assistant' AND NOT coalesce(starts_with(lead(text) OVER w, 'error:'), false) AS graded FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, max(CASE WHEN graded THEN turn END) OVER (PARTITION BY conv_id) AS last FROM a), u AS (SELECT conv_id, turn, graded, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]') AS toks FROM b WHERE turn <= last),
s AS (SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
k AS (SELECT conv_id, turn, graded, start + generate_subscripts(toks, 1) - 1 AS "at", unnest(toks) AS token FROM s)"""


def _tokens(spark, d):
    return D.token_rows(table(spark, d, "conversations"))


@query(MASK + ' SELECT conv_id, "at"::BIGINT AS "at", turn, token, graded FROM k')
def mask_labels(spark, d):
    return _tokens(spark, d).select("conv_id", F.col("at").cast("long").alias("at"), "turn", "token", "graded")


@query(MASK + ', g AS (SELECT conv_id, "at", "at" - row_number() OVER (PARTITION BY conv_id ORDER BY "at") AS g FROM k WHERE graded) SELECT conv_id, min("at")::BIGINT AS "begin", (max("at") + 1)::BIGINT AS "end" FROM g GROUP BY conv_id, g')
def graded_runs(spark, d):
    return D.graded_runs(_tokens(spark, d)).select("conv_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


@query(MASK + ", e AS (SELECT conv_id, count(*) AS n, count(*) FILTER (graded) AS ng FROM k GROUP BY conv_id HAVING count(*) <= 3072) SELECT count(*)::BIGINT AS n, round(avg(n), 6) AS mean_len, max(n)::BIGINT AS max_len, sum(ng)::BIGINT AS graded, round(avg(ng::DOUBLE / n), 6) AS fraction FROM e")
def sft_stats(spark, d):
    e = D.examples(_tokens(spark, d))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n"), 6).alias("mean_len"), F.max("n").alias("max_len"), F.sum("n_graded").alias("graded"), F.round(F.avg(F.col("n_graded") / F.col("n")), 6).alias("fraction"))


@query(MASK + ", e AS (SELECT conv_id, count(*) AS n FROM k GROUP BY conv_id HAVING count(*) <= 3072), m AS (SELECT *, max(n) OVER (PARTITION BY conv_id % 8) AS longest FROM e) SELECT conv_id, longest::BIGINT AS padded, n::BIGINT AS attended FROM m")
def pad_batch(spark, d):
    p = D.pad(D.examples(_tokens(spark, d)).select("conv_id", (F.col("conv_id") % 8).alias("batch"), "labels"))
    return p.select("conv_id", F.size("labels").cast("long").alias("padded"), F.aggregate("attention", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"))


@query(MASK + " SELECT conv_id, count(*) FILTER (graded AND turn IN (SELECT turn FROM conversations c WHERE c.conv_id = k.conv_id AND role <> 'assistant'))::BIGINT AS leaked FROM k GROUP BY conv_id")
def mask_leak_check(spark, d):
    roles = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return _tokens(spark, d).join(roles, ["conv_id", "turn"]).groupBy("conv_id").agg(F.count_if(F.col("graded") & (F.col("role") != "assistant")).alias("leaked"))


@query()
def mask_text_check(spark, d):
    t = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id")
    t1 = t.withColumn("first", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w))
    seen = t1.filter("role <> 'assistant' AND turn > first AND NOT startswith(text, 'error:')").select("conv_id", F.col("text").alias("body"))
    own = t.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text")).withColumn("a", X.parse_action(F.col("text")))
    answers = own.select("conv_id", F.when(F.col("a.name") == "answer", F.col("a.payload")).otherwise(F.col("text")).alias("answer"))
    return D.mask_findings(t, D.token_rows(t), seen, answers).select("conv_id", "n_runs", F.array_join("findings", ",").alias("findings"))


PRICES = [("A", 3.0, 15.0), ("N", 1.0, 5.0)]


@query("""WITH u AS (SELECT l_returnflag AS model, sum(l_partkey)::BIGINT AS prompt, sum(l_suppkey)::BIGINT AS cached, sum(l_linenumber)::BIGINT AS completion FROM lineitem GROUP BY 1)
SELECT model, prompt, completion, round((greatest(0, prompt - cached) * coalesce(i, 0) + cached * coalesce(i, 0) * 0.25 + completion * coalesce(o, 0)) / 1e6, 6)::DOUBLE AS usd FROM u LEFT JOIN (VALUES ('A', 3.0::DOUBLE, 15.0::DOUBLE), ('N', 1.0, 5.0)) p(m, i, o) ON m = model""")
def usage_cost(spark, d):
    u = table(spark, d, "lineitem").selectExpr("l_returnflag AS model", "cast(l_partkey as long) AS prompt", "cast(l_suppkey as long) AS cached", "cast(l_linenumber as long) AS completion")
    return D.usage_cost(u, spark.createDataFrame(PRICES, "model string, price_in double, price_out double"))


@query("WITH w AS (SELECT o_orderkey % 50 AS wave, count(*) AS cost FROM orders GROUP BY 1), b AS (SELECT wave, cost, coalesce(sum(cost) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w) SELECT wave, cost::BIGINT AS cost, before::BIGINT AS before FROM b WHERE before < 5000")
def cost_capped_waves(spark, d):
    w = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 50).alias("wave")).agg(F.count(F.lit(1)).alias("cost"))
    return D.waves_under_cap(w, 5000)


# ---- streams, drained


def _drained(spark, d, make, mode):
    from tessera.streaming import episodes as S

    return S.drain(make(S.read_events(spark, d)), mode, shared_folder(spark, "stream"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_step_means(spark, d):
    from tessera.streaming import episodes as S

    return _drained(spark, d, S.step_means, "complete")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type = 'purchase' AS buy, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, buy, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.buy, CASE WHEN r.buy OR r.n >= 8 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, n::INT AS n_turns, buy AS done FROM r WHERE buy OR n >= 8""")
def stream_episode_state(spark, d):
    from tessera.streaming import episodes as S

    return _drained(spark, d, S.episode_state, "append")


@query("SELECT user_id, min(ts)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, d):
    from tessera.streaming import episodes as S

    return _drained(spark, d, S.sessions, "complete")
