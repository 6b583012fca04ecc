"""Evaluations on disk: the rows of each arm, its summary from the scan that wrote them, and the card of all arms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKETS = ["wrong_answer", "correct_uncited", "correct_miscited", "correct_and_cited"]
#: Lines of a card: measure and what it says.
LINES = {
    "correct_rate": "correct (exact match)", "mean_title_f1": "picked the right sources", "mean_read_before_cite": "read before citing", "mean_cite_f1": "citation F1", "calls_read_rate": "read at least once",
    "terminated_cleanly_rate": "finished cleanly", "zero_tool_call_rate": "never used a tool", "capped_rate": "hit the cap of turns", "answered_rate": "gave an answer", "correct_and_cited_rate": "correct and cited",
}


def measures(max_turns: int = 8, when: Column | None = None) -> dict[str, Column]:
    """Aggregates over the classifier's rows, or over those that meet a condition: what an arm's summary holds.

    mean_f1 is the answer's; mean_*'s are means over the rows that have the value. hops_k counts episodes of k tool
    calls, the last one those of max_turns and more.
    """
    at = lambda c: c if when is None else F.when(when, c)
    mean = lambda c: F.round(F.avg(at(c.cast("double"))), 6)
    col = F.col
    of = {
        "n": F.count(at(F.lit(1))), "correct_rate": mean(col("correct")), "mean_cite_f1": mean(col("f1")), "mean_title_f1": mean(col("title_f1")), "mean_read_before_cite": mean(col("read_before_cite")),
        "mean_fabricated": mean(col("n_fabricated")), "mean_n_steps": mean(col("n_steps")), "mean_n_searches": mean(col("n_searches")), "mean_n_reads": mean(col("n_reads")), "mean_answer_words": mean(col("answer_words")),
        "mean_hit_rate": mean(col("hit_rate")), "calls_read_rate": mean(col("n_reads") > 0), "terminated_cleanly_rate": mean(col("done")), "zero_tool_call_rate": mean(col("n_tool_calls") == 0),
        "capped_rate": mean(col("n_tool_calls") >= max_turns), "answered_rate": mean(col("done")), "correct_and_cited_rate": mean(col("bucket") == BUCKETS[-1]),
    }
    of |= {f"pct_{b}": mean(col("bucket") == b) for b in BUCKETS}
    return of | {f"hops_{k}": F.count(at(F.when(F.least(col("n_tool_calls"), F.lit(max_turns)) == k, 1))) for k in range(max_turns + 1)}


def summarize(rows: DataFrame, *by: str, max_turns: int = 8) -> DataFrame:
    """The measures of all rows, or of each value of by."""
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in measures(max_turns).items()])


def write_arms(rows: DataFrame, folder: str, arms: list[str], meta: dict | None = None, max_turns: int = 8) -> dict[str, dict]:
    """Rows (arm, ...) of some arms into folder/rows, a part for each, and their summaries, which the write observes.

    The rows are read once. Only the parts of arms that rows hold are replaced; other arms in the folder stay. An arm
    without rows has n = 0 and no means, and keeps what an earlier write gave it. Rows of arms that aren't named are an
    error, as they would have no summary.
    """
    spark = rows.sparkSession
    seen = Observation("arms")
    named = F.coalesce(F.col("arm").isin(*arms), F.lit(False))
    per = [c.alias(f"{i}.{n}") for i, a in enumerate(arms) for n, c in measures(max_turns, F.col("arm") == a).items()]
    checked = rows.withColumn("arm", F.when(named, F.col("arm")).otherwise(F.raise_error(F.concat(F.lit("no such arm: "), F.coalesce("arm", F.lit("null"))))))
    observed = checked.observe(seen, *per)
    observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm").parquet(f"{folder}/rows")
    got = seen.get
    made = {a: {n: got[f"{i}.{n}"] for n in measures(max_turns)} for i, a in enumerate(arms)}
    lines = [(a, json.dumps({"summary": s, "meta": meta or {}}, sort_keys=True)) for a, s in made.items() if s["n"]]
    if lines:
        spark.createDataFrame(lines, "arm string, value string").repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm").text(f"{folder}/summaries")
    return made


def read_arms(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Summaries of all arms that a folder has: a few lines of JSON."""
    return {r["arm"]: json.loads(r["value"])["summary"] for r in spark.read.option("basePath", f"{folder}/summaries").text(f"{folder}/summaries").select("arm", "value").collect()}


def card(arms: dict[str, dict], name: str, base: str | None = None, meta: dict | None = None, max_turns: int = 8) -> list[str]:
    """Lines of a Markdown card: a header of settings, a row for each measure and a column for each arm, and the buckets."""
    names = list(arms)
    show = lambda v: "-" if v is None else f"{v:.3f}"
    head = ["---", *[f"{k}: {v}" for k, v in sorted(({"base_model": base} if base else {}).items())], *[f"{k}: {v}" for k, v in sorted((meta or {}).items())], "---", f"# {name}", ""]
    out = [*head, "| | " + " | ".join(names) + " |", "|---|" + "---|" * len(names)]
    out += ["| " + label + " | " + " | ".join(show(arms[a][key]) for a in names) + " |" for key, label in LINES.items()]
    out += ["", *[f"{a}: " + ", ".join(f"{b} {show(arms[a][f'pct_{b}'])}" for b in BUCKETS) + f"; {arms[a][f'hops_{max_turns}']} of {arms[a]['n']} at the cap of {max_turns} calls." for a in names]]
    return out
