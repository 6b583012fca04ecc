"""The layered reward of an episode with all its components, its two ramps read at the episode's training step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Weights and ramps of the reward. Fixed values.
WEIGHTS = {"w_outcome": 1.0, "w_ground": 0.5, "w_fab": 0.25, "w_format": 0.1, "floor": 0.5}
BETA = {"start": 20, "end": 120, "low": 0.5, "high": 0.15}
TOLL = {"start": 60, "end": 200, "low": 0.0, "high": 0.02}
MODES, OUTCOMES = ("gated", "additive", "cite_gated"), ("em", "f1")


def reward(rows: DataFrame, mode: str = "gated", outcome: Column | None = None, beta: Column | float = BETA["low"], toll: Column | float = TOLL["low"], weights: dict | None = None) -> tuple[Column, Column]:
    """The reward of rows with outcome, f1, n_citations, n_fabricated, format_error and n_steps, and its base before tolls."""
    w = WEIGHTS | (weights or {})
    o, g = F.col("outcome") if outcome is None else outcome, F.col("f1")
    beta, toll = (x if isinstance(x, Column) else F.lit(x) for x in (beta, toll))
    base = {
        "gated": o * (beta + (1 - beta) * g), "additive": w["w_outcome"] * o + w["w_ground"] * g,
        "cite_gated": F.when(F.col("n_citations") > 0, o * (w["floor"] + (1 - w["floor"]) * g)).otherwise(0.0),
    }[mode]
    return base - w["w_fab"] * F.col("n_fabricated") - w["w_format"] * F.col("format_error") - toll * F.col("n_steps"), base


def answer_f1(rows: DataFrame) -> Column:
    """Token F1 of the stripped final answer, the soft outcome."""
    return X.token_f1(X.strip_citations(F.coalesce("final_answer", F.lit(""))), F.col("answers"))


def infos(rows: DataFrame, step: Column, mode: str = "gated", kind: str = "em", weights: dict | None = None) -> DataFrame:
    """Rows of the classifier, with hit_rate, to step, reward and values: every component by name, absent ones left out.

    kind em takes exact match as outcome, f1 the answer's token F1. beta falls and the toll on steps rises with step. A
    row without step counts as step 0, where the toll is off.
    """
    at = F.coalesce(step.cast("long"), F.lit(0))
    rows = rows.withColumn("step", at)
    beta, toll = X.ramp(F.col("step"), BETA["start"], BETA["end"], BETA["low"], BETA["high"]), X.ramp(F.col("step"), TOLL["start"], TOLL["end"], TOLL["low"], TOLL["high"])
    rows = rows.withColumns({"o": F.col("outcome") if kind == "em" else answer_f1(rows), "beta": beta, "toll": toll})
    w = WEIGHTS | (weights or {})
    total, base = reward(rows, mode, F.col("o"), F.col("beta"), F.col("toll"), w)
    of = {
        "outcome": F.col("o"), "groundedness": F.col("f1"), "cite_f1": F.col("f1"), "cite_precision": F.col("precision"), "cite_recall": F.col("recall"), "cite_fabricated": F.col("n_fabricated"),
        "hit_rate": F.col("hit_rate"), "judge": F.col("judge") if "judge" in rows.columns else F.lit(0.0), "format_error": F.col("format_error"), "n_steps": F.col("n_steps"), "base": base,
        "fab_toll": w["w_fab"] * F.col("n_fabricated"), "fmt_toll": w["w_format"] * F.col("format_error"), "eff_toll": F.col("toll") * F.col("n_steps"), "lambda_eff": F.col("toll"), "beta": F.col("beta"),
        "n_citations": F.col("n_citations"), "n_reads": F.col("n_reads"), "n_searches": F.col("n_searches"), "n_tool_calls": F.col("n_tool_calls"), "answered": F.col("done"), "capped": ~F.col("done"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in of.items()])
    return rows.select("ep", "step", total.alias("reward"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("values"))
