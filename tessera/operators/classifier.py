"""The classifier's whole row, and the report over rows that were collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bars of citation F1 at which the yield of right episodes is counted. Fixed values.
BARS = (0.999, 0.75, 0.5, 0.34)


def classifier_rows(rows: DataFrame) -> DataFrame:
    """Rows of episodes with their citation report to the sixteen values of the classifier, and the episode."""
    ratio = lambda c: F.round(c, 6)
    return rows.select(
        "ep", "task_id", (F.col("n_unparsed") == 0).alias("parse_ok"), F.col("n_unparsed").alias("n_parse_failures"), (F.col("n_reads") > 0).alias("calls_read"), "n_reads", "n_searches", "n_tool_calls",
        F.col("done").alias("terminated_cleanly"), "correct", "n_citations", ratio("f1").alias("cite_f1"), ratio("precision").alias("cite_precision"), ratio("recall").alias("cite_recall"),
        ratio("title_f1").alias("title_f1"), ratio("read_before_cite").alias("read_before_cite_rate"), "bucket",
    )


def _counts(of: Column) -> Column:
    """Values of a column with how often they stand there, as text like a:3,b:1 in order of the value."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda x: F.concat(x["v"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")


def quality_report(classified: DataFrame, answers: DataFrame, gave_up: DataFrame) -> DataFrame:
    """One row about collected episodes: classifier_rows, answers (ep, final_answer) and the eps a failing service ended.

    Sizes, rates and means, episodes by bucket and by tool calls, right episodes and their questions at each bar of
    BARS, and of those at the first bar how varied they are: by tool calls, the most of one question, answer lengths.
    Without episodes it is a row of zeros and nulls.
    """
    rows = classified.join(gave_up.select("ep").distinct().withColumn("lost", F.lit(True)), "ep", "left").join(answers.select("ep", "final_answer"), "ep", "left")
    strict = F.col("correct") & (F.col("cite_f1") >= BARS[0])
    mean = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 6).alias(name)
    yields = [x for k, bar in enumerate(BARS) for x in (F.count_if(F.col("correct") & (F.col("cite_f1") >= bar)).alias(f"kept_{k}"), F.count_distinct(F.when(F.col("correct") & (F.col("cite_f1") >= bar), F.col("task_id"))).alias(f"questions_{k}"))]
    whole = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("task_id").alias("questions"), mean("correct", "correct_rate"), mean("cite_f1", "mean_cite_f1"), mean("title_f1", "mean_title_f1"),
        mean("read_before_cite_rate", "mean_read_before_cite"), mean("calls_read", "calls_read_rate"), mean("terminated_cleanly", "terminated_cleanly_rate"), mean("parse_ok", "parse_ok_rate"), mean("n_reads", "mean_n_reads"),
        mean("n_searches", "mean_n_searches"), F.count_if(F.coalesce("lost", F.lit(False))).alias("gave_up"), *yields,
    )
    words = F.size(F.filter(F.split(F.trim(F.coalesce("final_answer", F.lit(""))), r"(?U)\s+"), lambda w: w != ""))
    key = lambda k, v: F.struct(F.lit(k).alias("k"), F.coalesce(v, F.lit("")).alias("v"))
    calls = F.lpad(F.col("n_tool_calls").cast("string"), 2, "0")
    varied = {"kept_hops": calls, "answer_lengths": F.lpad(words.cast("string"), 4, "0"), "task": F.col("task_id")}
    keys = F.array(key("buckets", F.col("bucket")), key("hops", calls), *[F.when(strict, key(k, v)) for k, v in varied.items()])
    counts = rows.select(F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    most = counts.filter("k = 'task'").agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_of_a_question"))
    names = ["buckets", "hops", "kept_hops", "answer_lengths"]
    lists = counts.filter("k <> 'task'").agg(*[_counts(F.when(F.col("k") == k, F.struct("v", "n"))).alias(k) for k in names])
    return whole.crossJoin(most).crossJoin(lists)


def cause_report(causes: DataFrame) -> DataFrame:
    """(style, cause, finish_reason) to style, what (cause or finish_reason), value, n and its share among the style's."""
    each = causes.select("style", F.explode(F.array(F.struct(F.lit("cause").alias("what"), F.col("cause").alias("value")), F.struct(F.lit("finish_reason").alias("what"), F.coalesce("finish_reason", F.lit("None")).alias("value")))).alias("x"))
    counts = each.groupBy("style", "x.what", "x.value").agg(F.count(F.lit(1)).alias("n"))
    total = causes.groupBy("style").agg(F.count(F.lit(1)).alias("all"))
    return counts.join(F.broadcast(total), "style").select("style", "what", "value", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def finish_report(episodes: DataFrame) -> DataFrame:
    """Episodes of native calls (finish_mode, n_retries, n_thoughts) by finish: n, share, mean retries, any-thought rate."""
    total = episodes.agg(F.count(F.lit(1)).alias("all"))
    per = episodes.groupBy("finish_mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_retries"), 6).alias("mean_retries"), F.round(F.avg((F.col("n_thoughts") > 0).cast("double")), 6).alias("any_thought_rate"))
    return per.crossJoin(F.broadcast(total)).select("finish_mode", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "mean_retries", "any_thought_rate")
