"""Training steps: episodes get the step that was current at their time, and their components are averaged by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.streaming.machine import use_disk_state

#: Components of an episode's reward that are averaged by step, in the order of the log. Fixed values.
COMPONENTS = [
    "outcome", "groundedness", "cite_f1", "cite_precision", "cite_recall", "cite_fabricated", "cite_uncited_claims", "hit_rate", "judge", "format_error", "n_steps", "base",
    "fab_toll", "fmt_toll", "eff_toll", "lambda_eff", "beta", "n_citations", "n_reads", "n_searches", "n_tool_calls", "answered", "capped",
]
#: How the keys of a call begin that carries training data. Fixed values.
TRAIN = ["actor/", "batch/"]
#: Stretches that intervals are cut into, by their number, and how long an interval holds at most.
FINE, HORIZON = 8, "40 days"


def step_intervals(announced: DataFrame) -> DataFrame:
    """Announcements (ts, step) of a table to begin, end (null for the newest) and step; a step never falls.

    A counter that was set back keeps its greatest value, and of announcements at one time the greatest counts. The
    announcements of a run are few, a row a training step; they pass through one ordered window.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy("begin")
    at = announced.filter("ts is not null and step is not null").groupBy(F.col("ts").alias("begin")).agg(F.max(F.col("step").cast("long")).alias("step"))
    risen = at.withColumn("step", F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return risen.select("begin", F.lead("begin").over(order).alias("end"), "step")


def _buckets(begin: Column, end: Column, width: int) -> Column:
    """Numbers of the stretches of width seconds that an interval touches."""
    return F.sequence(F.floor(F.unix_seconds(begin) / width), F.floor(F.unix_seconds(end) / width))


def _until(horizon: str) -> Column:
    """How far an interval of begin and end reaches: to its end, at most horizon."""
    far = F.col("begin") + F.expr(f"INTERVAL {horizon}")
    return F.least(F.coalesce("end", far), far)


def stretch(steps: DataFrame, horizon: str = HORIZON) -> int:
    """Seconds of a stretch for with_step, from a table of the intervals: their time in all, cut into FINE stretches an interval.

    So an interval is in FINE + 1 stretches on average, and a stretch holds fewer intervals than two on average, however
    many are announced.
    """
    n, seconds = steps.agg(F.count(F.lit(1)), F.sum(F.unix_seconds(_until(horizon)) - F.unix_seconds("begin"))).first()
    return max(1, -(-(seconds or 0) // (FINE * n))) if n else 1


def with_step(events: DataFrame, steps: DataFrame, late: str = "1 hour", width: int = 86_400, horizon: str = HORIZON) -> DataFrame:
    """Streams of events (ts, ...) and of steps (begin, end, step) to events with the step that was current at their time.

    Events before the first step have none and are left out. Both sides wait in state until the watermark shows that no
    partner can come; the join's key is the stretch of width seconds, and an interval stands in each that it touches. An
    event is compared with all intervals of its stretch, so width has to suit their number: stretch gives it.
    The newest step, whose end is null, holds for horizon; intervals that are longer are cut there.
    """
    s = steps.withColumn("end", _until(horizon)).withWatermark("begin", late)
    s = s.withColumn("bucket", F.explode(_buckets(F.col("begin"), F.col("end"), width))).select(F.col("bucket").alias("s_bucket"), "begin", "end", "step")
    e = events.withWatermark("ts", late).withColumn("bucket", F.floor(F.unix_seconds("ts") / width))
    on = (F.col("bucket") == F.col("s_bucket")) & (F.col("ts") >= F.col("begin")) & (F.col("ts") < F.col("end")) & (F.col("ts") <= F.col("begin") + F.expr(f"INTERVAL {horizon}"))
    return e.join(s, on).select(*events.columns, "step")


def is_train_call(keys: Column) -> Column:
    """Whether a log call carries training data, alone or beside an evaluation's: asked of what it has, not of what it lacks."""
    return F.coalesce(F.exists(keys, lambda k: F.startswith(k, F.lit(TRAIN[0])) | F.startswith(k, F.lit(TRAIN[1]))), F.lit(False))


def component_means(infos: DataFrame) -> DataFrame:
    """Episodes (step, values map<string,double>), a table or a stream, to a row a step: each component's mean over the
    episodes that have it (null if none has), the share with a citation, and n_episodes."""
    value = lambda c: F.try_element_at("values", F.lit(c))
    means = [F.round(F.avg(value(c)), 6).alias(c) for c in COMPONENTS]
    cited = F.round(F.avg((F.coalesce(value("n_citations"), F.lit(0.0)) > 0).cast("double")), 6).alias("pct_rollouts_with_citation")
    return infos.groupBy("step").agg(*means, cited, F.count(F.lit(1)).alias("n_episodes"))


def logged(means: DataFrame, calls: DataFrame) -> DataFrame:
    """Means of the steps that a log call (step, keys) with training data reports; others wait for theirs, unmerged."""
    steps = calls.filter(is_train_call(F.col("keys"))).select("step").distinct()
    return means.join(steps, "step", "left_semi")
