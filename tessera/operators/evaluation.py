"""Roll-ups, slices, comparisons, probes and gates over evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.selection import index_quantile


def mean(c: str, name: str | None = None) -> Column:
    return F.round(F.avg(F.col(c).cast("double")), 6).alias(name or c)


def aggregate(rows: DataFrame) -> DataFrame:
    """Mean of every numeric and boolean column over the rows that have it, and n, all rows; no row if there is none."""
    kinds = (T.NumericType, T.BooleanType)
    columns = [f.name for f in rows.schema.fields if isinstance(f.dataType, kinds)]
    return rows.agg(F.count(F.lit(1)).alias("n"), *[mean(c) for c in columns]).filter("n > 0")


def share(rows: DataFrame, by: str) -> DataFrame:
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def with_meta(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """rows (task_id, ...) with dataset and hops of meta (task_id, dataset, n_hops), where they are known.

    Without a dataset it is what the task's id has before its first hyphen; without hops, or with 0, they are 2 for
    sources named hotpot or hotpotqa, and else null, which slices leave out.
    """
    joined = rows.join(meta.select("task_id", F.col("dataset").alias("of"), F.col("n_hops").alias("h")).dropDuplicates(["task_id"]), "task_id", "left")
    source = F.coalesce(F.when(F.col("of") != "", F.col("of")), F.split_part("task_id", F.lit("-"), F.lit(1)))
    hops = F.coalesce(F.when(F.col("h") != 0, F.col("h")), F.when(source.isin("hotpot", "hotpotqa"), 2))
    return joined.withColumns({"dataset": source, "n_hops": hops.cast("int")}).drop("of", "h")


def slices(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per value of each key and one for all, by grouping sets; slice names the key."""
    measures = ["correct", "f1", "good", "capped"]
    rows = rows.withColumn("good", F.col("bucket") == "correct_and_cited")
    aggs = [F.count(F.lit(1)).alias("n"), *[mean(m) for m in measures]]
    out = rows.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("gid"), *aggs)
    name = F.lit("all")
    for i, k in enumerate(keys):
        gid = 2 ** len(keys) - 1 - 2 ** (len(keys) - 1 - i)
        name = F.when(F.col("gid") == gid, F.lit(k)).otherwise(name)
    return out.select(name.alias("slice"), F.coalesce(*[F.col(k).cast("string") for k in keys], F.lit("")).alias("value"), "n", *measures)


def pivot_arms(rows: DataFrame, arms: list[str], measures: list[str]) -> DataFrame:
    """A row per measure with each arm's mean and its difference from the first arm."""
    long = rows.select("arm", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])).alias("x"))
    wide = long.groupBy("x.measure").pivot("arm", arms).agg(F.round(F.avg("x.v"), 6))
    return wide.select("measure", *arms, *[F.round(F.col(a) - F.col(arms[0]), 6).alias(f"delta_{a}") for a in arms[1:]])


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Questions right in both, one or neither of two arms (task_id, correct)."""
    both = a.select("task_id", F.col("correct").alias("x")).join(b.select("task_id", F.col("correct").alias("y")), "task_id")
    of = lambda x, y, name: F.count_if((F.col("x") == x) & (F.col("y") == y)).alias(name)
    return both.agg(of(True, True, "both"), of(True, False, "only_a"), of(False, True, "only_b"), of(False, False, "neither"))


def probes(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """reasons: what looks like gaming between two one-row summaries (em, f1, hit_rate, n_steps, fabricated, words)."""
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns])
    t = tuned.select(*[F.col(c).alias(f"t_{c}") for c in tuned.columns])
    rules = {
        "MEMORY-GUESSING": (F.col("t_em") > F.col("b_em") + 0.02) & (F.col("t_hit_rate") <= F.col("b_hit_rate") + 0.01),
        "TOOL-AVOIDANCE": F.col("t_n_steps") < 1.5, "FABRICATION": F.col("t_fabricated") > F.col("b_fabricated") + 0.05,
        "LENGTH-INFLATION": (F.col("t_words") > 1.5 * F.col("b_words")) & (F.col("t_f1") <= F.col("b_f1") + 0.02),
    }
    return b.crossJoin(t).withColumn("probes", F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull()))


def gate(base: DataFrame, tuned: DataFrame, margin: float = 0.05) -> DataFrame:
    """passed and reasons: enough gain in em, no loss in citation F1, no probe."""
    p = probes(base, tuned)
    own = F.filter(F.array(F.when(F.col("t_em") - F.col("b_em") < margin, F.lit("em gain")), F.when(F.col("t_f1") < F.col("b_f1") - 0.02, F.lit("f1 loss"))), lambda x: x.isNotNull())
    return p.withColumn("all", F.concat(own, "probes")).select((F.size("all") == 0).alias("passed"), F.array_join("all", "; ").alias("reasons"))


def bootstrap(pairs: DataFrame, draws: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean difference of pairs (i from 0 on, d) and the interval of its resampled means, by an arithmetic generator."""
    n = pairs.count()
    drawn = pairs.sparkSession.range(draws).withColumnRenamed("id", "b").crossJoin(F.broadcast(pairs.select(F.col("i").alias("j"))) if n < 100_000 else pairs.select(F.col("i").alias("j")))
    drawn = drawn.select("b", ((F.col("b") * 7919 + F.col("j") * 104729 + F.col("b") * F.col("j") * 31) % max(n, 1)).alias("i"))
    means = drawn.join(pairs, "i").groupBy("b").agg(F.round(F.avg("d"), 6).alias("m"))
    at = index_quantile(means, "m", [low, high])
    ends = at.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return pairs.agg(F.round(F.avg("d"), 6).alias("delta")).crossJoin(ends)


def group_advantage(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    """rows (grp, id, reward) with each one's advantage inside its group."""
    w = Window.partitionBy("grp")
    return rows.withColumn("advantage", F.round((F.col("reward") - F.avg("reward").over(w)) / (F.stddev_pop("reward").over(w) + eps), 6))


def group_health(rows: DataFrame) -> DataFrame:
    """Shares of groups whose rewards are all positive, none positive, or all equal."""
    g = rows.groupBy("grp").agg(F.bool_and(F.col("reward") > 0).alias("all_"), F.bool_and(F.col("reward") <= 0).alias("none_"), (F.min("reward") == F.max("reward")).alias("flat"))
    return g.agg(mean("all_", "solve_all"), mean("none_", "solve_none"), mean("flat", "zero_variance"), F.count(F.lit(1)).alias("groups"))
