"""Named queries over streams: keyed episodes, resumed logs, steps at their time, components by training step."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rewards as W
from tessera.plans.catalogue import _drained, _rows, query
from tessera.plans.views import table
from tessera.session import shared_folder
from tessera.streaming import episodes as S
from tessera.streaming import machine as M
from tessera.streaming import sinks
from tessera.streaming import steps as T

CAP, IDLE_MS = 8, 12 * 3_600_000


@query(f"""WITH RECURSIVE wm AS (SELECT max(epoch_us(ts) // 1000) - 3600000 AS wm FROM events),
e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS buy, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events, wm WHERE epoch_us(ts) // 1000 < wm),
r AS (SELECT user_id, k, ms, buy, 1 AS n, 1 AS ep FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.ms, e.buy, CASE WHEN r.buy OR r.n >= {CAP} OR e.ms > r.ms + {IDLE_MS} THEN 1 ELSE r.n + 1 END, CASE WHEN r.buy OR r.n >= {CAP} OR e.ms > r.ms + {IDLE_MS} THEN r.ep + 1 ELSE r.ep END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1),
x AS (SELECT user_id, ep, min(ms) AS began, max(ms) AS last, max(n) AS n, bool_or(buy) AS buy, max(ep) OVER (PARTITION BY user_id) AS newest FROM r GROUP BY user_id, ep)
SELECT user_id AS key, make_timestamp(began * 1000) AS began, make_timestamp((last + CASE WHEN buy OR n >= {CAP} THEN 0 ELSE {IDLE_MS} END) * 1000) AS ended, n::INT AS n_turns, CASE WHEN buy THEN 'finished' WHEN n >= {CAP} THEN 'capped' ELSE 'timed_out' END AS outcome
FROM x, wm WHERE buy OR n >= {CAP} OR ep < newest OR last + {IDLE_MS} < wm""")
def stream_episodes(spark, d):
    return _drained(spark, d, lambda e: M.episodes(e, "user_id", "ts", "event_id", F.col("event_type") == "purchase", CAP, "12 hours"), "append")


def _resumed(spark, d):
    """The events as a log, and the log delivered again as a whole by another reader, into one sink."""
    folder = shared_folder(spark, "resume")
    for log in ("first", "again"):
        sinks.run(S.read_events(spark, d), sinks.append_new(folder, ["event_id"], ["ts"], log), f"{folder}/{log}")
    return spark.read.schema(S.EVENTS).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


@query("SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT event_id FROM events)")
def stream_dedupe_resume(spark, d):
    return _resumed(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events ORDER BY event_id, ts) GROUP BY user_id")
def stream_resumed_rows(spark, d):
    return _resumed(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


#: A step is announced with every 97th event, and set back once in five; a counter never falls.
ANNOUNCED = "SELECT ts, CASE WHEN (event_id // 97) % 5 = 4 THEN event_id // 97 - 3 ELSE event_id // 97 END AS step FROM events WHERE event_id % 97 = 0"


def _intervals(spark, d):
    announced = table(spark, d, "events").filter("event_id % 97 = 0").selectExpr("ts", "CASE WHEN (event_id div 97) % 5 = 4 THEN event_id div 97 - 3 ELSE event_id div 97 END AS step")
    folder, row = shared_folder(spark, "steps"), "begin timestamp, end timestamp, step long"
    T.step_intervals(announced).write.parquet(folder)
    return spark.readStream.schema(row).parquet(folder), T.stretch(spark.read.schema(row).parquet(folder))


@query(f"WITH a AS ({ANNOUNCED}), s AS (SELECT ts, max(step) OVER (ORDER BY ts) AS step FROM a) SELECT s.step::BIGINT AS step, event_type, count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_event, max(event_id)::BIGINT AS last_event FROM events e ASOF JOIN s ON e.ts >= s.ts GROUP BY ALL")
def stream_with_step(spark, d):
    steps, width = _intervals(spark, d)
    rows = _drained(spark, d, lambda e: T.with_step(e.select("event_id", "ts", "event_type"), steps, width=width), "append")
    return rows.groupBy("step", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


# ---- components by training step

#: The step of an episode and what the log call of a step carries: an evaluation alone at every seventh one.
STEP, CALLS = "(ep * 7) % 251", "CASE WHEN step % 7 = 0 THEN array('val/test') WHEN step % 7 = 1 THEN array('val/test', 'batch/solve_none') ELSE array('actor/loss', 'perf/time') END AS keys"
_BETA = "CASE WHEN step <= 20 THEN 0.5 WHEN step >= 120 THEN 0.15 ELSE 0.5 + (step - 20) / 100.0::DOUBLE * (0.15 - 0.5) END::DOUBLE"
_EFF = "CASE WHEN step <= 60 THEN 0.0 WHEN step >= 200 THEN 0.02 ELSE (step - 60) / 140.0::DOUBLE * 0.02 END::DOUBLE"
_STEPPED = f", st AS (SELECT *, {STEP} AS step FROM rows), rr AS (SELECT *, {_BETA} AS beta, {_EFF} AS eff FROM st)"
_OF = {
    "outcome": "outcome", "groundedness": "f1", "cite_f1": "f1", "cite_precision": '"precision"', "cite_recall": "recall", "cite_fabricated": "n_fabricated", "cite_uncited_claims": "NULL::DOUBLE", "hit_rate": "hit_rate",
    "judge": "0.0", "format_error": "format_error", "n_steps": "n_steps", "base": "outcome * (beta + (1 - beta) * f1)", "fab_toll": "0.25 * n_fabricated", "fmt_toll": "0.1 * format_error", "eff_toll": "eff * n_steps", "lambda_eff": "eff",
    "beta": "beta", "n_citations": "n_citations", "n_reads": "n_reads", "n_searches": "n_searches", "n_tool_calls": "n_tool_calls", "answered": "done::INT", "capped": "(NOT done)::INT",
}
_MEANS = ", ".join(f"round(avg(({sql})::DOUBLE), 6) AS {name}" for name, sql in _OF.items()) + ", round(avg((n_citations > 0)::INT::DOUBLE), 6) AS pct_rollouts_with_citation, count(*)::BIGINT AS n_episodes"


def _infos(spark, d, kind="em"):
    return W.infos(_rows(spark, d), (F.col("ep") * 7) % 251, "gated", kind)


@query(_STEPPED + f" SELECT step, {_MEANS} FROM rr GROUP BY step", chain=True)
def reward_components_by_step(spark, d):
    return T.component_means(_infos(spark, d))


@query(_STEPPED + f" SELECT step, {_MEANS} FROM rr WHERE step % 7 <> 0 GROUP BY step", chain=True)
def stream_step_components(spark, d):
    """As a stream of many small batches into an upsert sink; steps that only an evaluation's call names aren't reported."""
    folder = shared_folder(spark, "components")
    _infos(spark, d).select("step", "values").repartition(6).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("step long, values map<string,double>").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    means = T.component_means(stream)
    sinks.run(means, sinks.upsert(folder, ["step"]), folder, "update")
    rows = sinks.latest(spark, folder, ", ".join(f"`{n}` {t}" for n, t in means.dtypes), ["step"])
    return T.logged(rows, rows.selectExpr("step", CALLS))


def _with_ramps(mode: str, kind: str, core: str) -> None:
    def run(spark, d):
        return W.infos(_rows(spark, d), (F.col("ep") * 7) % 251, mode, kind).select("ep", "step", F.round("reward", 6).alias("reward"))

    run.__name__ = f"reward_ramped_{mode}_{kind}"
    o = "outcome" if kind == "em" else "answer_f1"
    query(_STEPPED + f" SELECT ep, step, round({core.format(o=o)} - 0.25 * n_fabricated - 0.1 * format_error - eff * n_steps, 6) AS reward FROM rr", chain=True)(run)


for _mode, _core in {"gated": "{o} * (beta + (1 - beta) * f1)", "additive": "({o} + 0.5 * f1)", "cite_gated": "(CASE WHEN n_citations > 0 THEN {o} * (0.5 + 0.5 * f1) ELSE 0 END)"}.items():
    for _kind in W.OUTCOMES:
        _with_ramps(_mode, _kind, _core)
