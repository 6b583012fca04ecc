"""Recorded turns to steps, episodes and their citation reports.

The state machine of an episode is set-oriented once its turns are recorded: the first parsed answer or the cap ends
it, later turns go, and every turn before becomes a step. Windows over one episode do the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

MAX_TURNS, MAX_OBS = 8, 1200


def fold(turns: DataFrame, tools: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """turns (ep, t, text) and tools (ep, t, obs, ok, titles), what a tool says if turn t calls it, to steps.

    An unparsed turn is a step with no call, but not at the cap; a turn after the end is none. answer ends the episode
    even with an empty payload.
    """
    parsed = turns.withColumn("a", X.parse_action(F.col("text"))).select("ep", "t", "text", "a.*")
    w = Window.partitionBy("ep")
    end = F.least(F.min(F.when((F.col("name") == "answer") & F.col("parse_ok"), F.col("t"))).over(w), F.lit(max_turns))
    parsed = parsed.withColumn("t_end", end).filter("t <= t_end").filter((F.col("t") < max_turns) | F.col("parse_ok"))
    steps = parsed.join(tools, ["ep", "t"], "left")
    answer = F.col("parse_ok") & (F.col("name") == "answer")
    return steps.select(
        "ep", "t", "thought", F.when(F.col("parse_ok"), F.col("name")).alias("name"), F.when(F.col("parse_ok"), F.col("payload")).alias("payload"), "parse_ok",
        (F.col("parse_ok") & (answer | F.coalesce("ok", F.lit(False)))).alias("ok"),
        F.when(~F.col("parse_ok"), "parse").when(answer | F.col("ok"), F.lit(None)).otherwise("tool_error").alias("error"),
        F.when(answer, F.col("payload")).otherwise(F.substring("obs", 1, MAX_OBS)).alias("obs"),
        F.when(F.col("parse_ok") & ~answer & F.col("ok"), F.col("titles")).otherwise(F.array().cast("array<string>")).alias("titles"),
    )


def assemble(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per episode with its steps in order, the final answer, the gold and the counters over steps."""
    row = F.struct("t", "thought", "name", "payload", "parse_ok", "ok", "error", "obs", "titles")
    eps = steps.groupBy("ep").agg(F.array_sort(F.collect_list(row)).alias("steps"))
    eps = tasks.join(eps, "ep", "left").withColumn("steps", F.coalesce("steps", F.expr("array()").cast(eps.schema["steps"].dataType)))
    last = F.try_element_at(F.filter("steps", lambda s: s["name"] == "answer"), F.lit(1))
    count = lambda f: F.size(F.filter("steps", f))
    return eps.withColumns({
        "done": F.exists("steps", lambda s: s["name"].eqNullSafe(F.lit("answer"))), "final_answer": last["payload"],
        "n_steps": F.size("steps"), "n_tool_calls": count(lambda s: s["name"].isNotNull()), "n_searches": count(lambda s: s["name"] == "search"),
        "n_reads": count(lambda s: s["name"] == "read"), "n_bad": count(lambda s: ~s["parse_ok"] | s["error"].isNotNull()), "n_unparsed": count(lambda s: ~s["parse_ok"]),
        "retrieved": F.array_distinct(F.flatten(F.transform("steps", lambda s: s["titles"]))),
    })


def hit_rate(gold: Column, retrieved: Column) -> Column:
    """Share of distinct gold titles retrieved, as written; 1 without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(g, retrieved)) / F.greatest(F.size(g), F.lit(1)))


def evidence(steps: DataFrame) -> DataFrame:
    """ep, norm_title, body: what the last successful read of a title showed, without its heading line."""
    reads = steps.filter("name = 'read' and ok and size(titles) > 0").withColumn("norm_title", X.norm_title(F.col("titles")[0]))
    body = F.when(F.col("obs").startswith("["), F.regexp_replace("obs", r"(?s)^\[.*?\]\n", "")).otherwise(F.col("obs"))
    return reads.groupBy("ep", "norm_title").agg(F.max_by(body, "t").alias("body"))


def _ratio(a: Column, b: Column, default: float) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(default))


#: Counts of a citation report; n_cited are different titles, tp, fp and fn ask for a read, title_* don't.
COUNTERS = ["n_citations", "n_resolved", "n_fabricated", "n_uncited", "tp", "fp", "fn", "n_gold", "title_tp", "title_fp", "title_fn", "n_cited", "n_cited_read"]


def citation_report(episodes: DataFrame) -> DataFrame:
    """ep and the counters and ratios of its citations.

    A cited title counts for the F1 if it is gold and was read; it is fabricated if it was never retrieved. Titles are
    compared normalised; n_citations counts repeats.
    """
    norm = lambda a: F.array_distinct(F.transform(a, X.norm_title))
    reads = F.flatten(F.transform(F.filter("steps", lambda s: (s["name"] == "read") & s["ok"]), lambda s: s["titles"]))
    e = episodes.select("ep", X.citations(F.col("final_answer")).alias("cites"), norm(F.col("gold")).alias("g"), norm(F.col("retrieved")).alias("r"), norm(reads).alias("rd"), X.uncited_claims(F.col("final_answer")).alias("n_uncited"))
    e = e.withColumn("c", norm(F.transform("cites", lambda x: x["title"]))).withColumns({"hit": F.array_intersect(F.array_intersect("c", "g"), "rd"), "title_hit": F.array_intersect("c", "g")})
    n = F.size
    e = e.withColumns({
        "n_citations": n("cites"), "n_resolved": n(F.filter("cites", lambda x: F.array_contains("r", X.norm_title(x["title"])))), "tp": n("hit"), "fp": n(F.array_except("c", "hit")), "fn": n(F.array_except("g", "hit")),
        "title_tp": n("title_hit"), "n_cited_read": n(F.array_intersect("c", "rd")), "n_cited": n("c"), "n_gold": n("g"),
    })
    e = e.withColumns({
        "n_fabricated": F.col("n_citations") - F.col("n_resolved"), "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0),
        "title_precision": _ratio(F.col("title_tp"), F.col("n_cited"), 0.0), "title_recall": _ratio(F.col("title_tp"), F.col("n_gold"), 0.0), "read_before_cite": _ratio(F.col("n_cited_read"), F.col("n_cited"), 0.0),
    })
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-12))).otherwise(0.0)
    e = e.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "title_f1": f1(F.col("title_precision"), F.col("title_recall"))})
    e = e.withColumns({"title_fp": F.col("n_cited") - F.col("title_tp"), "title_fn": F.col("n_gold") - F.col("title_tp")})
    return e.select("ep", *COUNTERS, "precision", "recall", "f1", "title_precision", "title_recall", "title_f1", "read_before_cite")


def format_error(episodes: DataFrame) -> Column:
    """1 without steps, else the share of steps whose action didn't parse plus a half if the episode isn't done, at most 1."""
    return F.when(F.col("n_steps") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("n_unparsed") / F.greatest("n_steps", F.lit(1)) + F.when(F.col("done"), 0.0).otherwise(0.5)))


def eval_rows(episodes: DataFrame, report: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The classifier's row of each episode, with its outcome bucket."""
    rows = episodes.join(report, "ep")
    pred = X.strip_citations(F.coalesce("final_answer", F.lit("")))
    rows = rows.withColumn("correct", F.col("done") & X.exact_match(pred, F.col("answers"))).withColumn("outcome", F.col("correct").cast("double"))
    bucket = F.when(~F.col("correct"), "wrong_answer").when(F.col("n_citations") == 0, "correct_uncited").when(F.col("f1") < 0.999, "correct_miscited").otherwise("correct_and_cited")
    return rows.withColumns({"bucket": bucket, "capped": F.col("n_tool_calls") >= max_turns, "format_error": format_error(rows), "answer_words": F.size(X.answer_tokens(F.col("final_answer")))})
