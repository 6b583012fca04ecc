"""Splits, sampling, tiers, resumable collection, masks and structure checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_citations

IGNORE = -100


def order_key(id_: Column, seed: int = 0) -> Column:
    """A stable shuffle's key: a longer draw begins with the shorter one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"))


def draw(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """The first n rows of the stable shuffle."""
    return rows.orderBy(order_key(F.col(id_col), seed), id_col).limit(n)


def index_ranges(rows: DataFrame, id_col: str, ranges: dict[str, tuple[int, int]], seed: int = 0) -> DataFrame:
    """Rows of the stable shuffle's places [a, b) with the name of their range as split."""
    most = max(b for _, b in ranges.values())
    drawn = draw(rows.select(id_col), id_col, most, seed).withColumn("place", F.row_number().over(Window.orderBy(order_key(F.col(id_col), seed), id_col)) - 1)
    name = F.lit(None).cast("string")
    for k, (a, b) in ranges.items():
        name = F.when((F.col("place") >= a) & (F.col("place") < b), F.lit(k)).otherwise(name)
    return drawn.withColumn("split", name).filter("split is not null")


def leaks(splits: DataFrame, id_col: str) -> DataFrame:
    """Ids that stand in more than one split."""
    return splits.groupBy(id_col).agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def tier(correct: Column, f1: Column, gave_up: Column, has_history: Column, gold: Column, read: Column, bar: float = 0.999) -> Column:
    """drop_api, drop_nohistory, A, B or C; the order of the rules matters."""
    hit = F.size(F.array_intersect(gold, read)) / F.greatest(F.size(F.array_distinct(gold)), F.lit(1))
    return F.when(gave_up, "drop_api").when(~has_history, "drop_nohistory").when(correct & (f1 >= bar), "A").when(hit >= 0.5, "B").otherwise("C")


def process_clean(rows: DataFrame) -> DataFrame:
    """Finished episodes that cite something and read whatever they cite, right or wrong.

    Where rows have the columns has_history and gave_up, episodes without recorded turns, and those that a failing
    service ended, go too; null counts as no history, and as not given up.
    """
    keep = F.col("done") & (F.col("n_citations") > 0) & (F.col("read_before_cite") >= 0.999)
    if "has_history" in rows.columns:
        keep &= F.coalesce("has_history", F.lit(False))
    if "gave_up" in rows.columns:
        keep &= ~F.coalesce("gave_up", F.lit(False))
    return rows.filter(F.coalesce(keep, F.lit(False)))


def yield_by_bar(rows: DataFrame, bars: tuple[float, ...] = (0.999, 0.75, 0.5, 0.34)) -> DataFrame:
    """Rows and distinct questions at or above each bar of f1."""
    each = rows.select("task_id", "f1", F.explode(F.array(*[F.lit(b) for b in bars])).alias("bar"))
    return each.groupBy("bar").agg(F.count_if(F.col("f1") >= F.col("bar")).alias("n"), F.count_distinct(F.when(F.col("f1") >= F.col("bar"), F.col("task_id"))).alias("questions"))


def todo(tasks: DataFrame, done: DataFrame, k: int, batch: int) -> DataFrame:
    """The first tasks (task_id) that were done fewer than k times."""
    counts = done.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return tasks.join(counts, "task_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < k).orderBy("task_id").limit(batch)


def structure_findings(turns: DataFrame) -> DataFrame:
    """conv_id, severity, key: what is wrong with each conversation (conv_id, turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("prev", F.lag("role").over(w)).withColumn("rn", F.row_number().over(w))
    per = t.groupBy("conv_id").agg(F.max(F.when(F.col("rn") == 1, F.col("role"))).alias("first"), F.max((F.col("role") == F.col("prev")).cast("int")).alias("same"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.max_by("role", "turn").alias("last"))
    rules = {("fail", "not_user_first"): F.col("first") != "user", ("fail", "roles_do_not_alternate"): F.coalesce(F.col("same"), F.lit(0)) == 1, ("fail", "no_assistant_turn"): F.col("n_assistant") == 0, ("warn", "ends_on_user"): F.col("last") == "user"}
    found = F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("key"))) for (s, k), c in rules.items()])
    return per.select("conv_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("conv_id", "x.severity", "x.key")


def first_violations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, before, role: where each conversation (conv_id, turn, role) has one role twice in a row for the first time."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    again = turns.withColumn("before", F.lag("role").over(w)).filter(F.col("before") == F.col("role"))
    first = again.groupBy("conv_id").agg(F.min_by(F.struct("turn", "before", "role"), "turn").alias("x"))
    return first.select("conv_id", "x.turn", "x.before", "x.role")


def findings_report(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("example"))


def token_rows(turns: DataFrame) -> DataFrame:
    """One row per token of a conversation: conv_id, at (from 0), turn, token, graded.

    Tokens are words or single marks. Graded are the assistant's, but not those of a turn that the next one rejects with
    'error:'; what follows the last graded turn is left out.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    graded = (F.col("role") == "assistant") & ~F.coalesce(F.lead("text").over(w).startswith("error:"), F.lit(False))
    t = turns.withColumn("graded", graded)
    t = t.withColumn("last", F.max(F.when(F.col("graded"), F.col("turn"))).over(Window.partitionBy("conv_id"))).filter("turn <= last")
    t = t.withColumn("tokens", F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0)))
    start = F.coalesce(F.sum(F.size("tokens")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("start", start).select("conv_id", "turn", "start", "graded", F.posexplode("tokens").alias("p", "token")).select("conv_id", (F.col("start") + F.col("p")).alias("at"), "turn", "token", "graded")


def graded_runs(tokens: DataFrame) -> DataFrame:
    """Runs of neighbouring graded tokens: conv_id, begin, end (exclusive)."""
    w = Window.partitionBy("conv_id").orderBy("at")
    island = tokens.filter("graded").withColumn("g", F.col("at") - F.row_number().over(w))
    return island.groupBy("conv_id", "g").agg(F.min("at").alias("begin"), (F.max("at") + 1).alias("end")).drop("g")


def mask_findings(turns: DataFrame, tokens: DataFrame, observations: DataFrame, answers: DataFrame, probe: int = 24) -> DataFrame:
    """What is wrong with a mask, by its text: a row per conversation of turns with conv_id, n_runs and findings.

    tokens are like those of token_rows; observations (conv_id, body) must not be graded, judged by their first probe
    characters where they have so many; of answers (conv_id, answer) the first word must be. Text is compared in lower
    case without blanks, as tokens hold none; a run may span neighbouring assistant turns.
    """
    flat = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    first = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.withColumn("body", flat(F.col("text"))).filter("body <> ''").withColumn("own", F.col("role").eqNullSafe("assistant"))
    said = said.withColumn("g", F.count_if(~F.col("own")).over(w)).filter("own")
    of = lambda name, x: F.transform(F.array_sort(F.collect_list(F.struct(name, x))), lambda r: r[x])
    said = said.groupBy("conv_id", "g").agg(F.array_join(of("turn", "body"), "").alias("body"), F.count(F.lit(1)).alias("m"))
    said = said.groupBy("conv_id").agg(F.collect_list("body").alias("said"), F.sum("m").alias("n_turns"))
    island = tokens.filter("graded").withColumn("g", F.col("at") - F.row_number().over(Window.partitionBy("conv_id").orderBy("at")))
    runs = island.groupBy("conv_id", "g").agg(F.min("at").alias("begin"), F.lower(F.array_join(of("at", "token"), "")).alias("run"))
    runs = runs.groupBy("conv_id").agg(F.collect_list("run").alias("runs"), F.min("begin").alias("begin"))
    seen = observations.withColumn("p", first(F.regexp_replace(F.col("body"), r"(?s)^\[.*?\]\n", "")).substr(1, probe)).filter(F.length("p") >= probe)
    seen = seen.groupBy("conv_id").agg(F.collect_set(flat(F.col("p"))).alias("seen"))
    word = answers.select("conv_id", F.element_at(F.split(first(strip_citations(F.col("answer"))), " "), 1).alias("word"))
    rows = turns.select("conv_id").distinct()
    for part in (said, runs, seen, word):
        rows = rows.join(part, "conv_id", "left")
    none = F.array().cast("array<string>")
    ran = F.coalesce("runs", none)
    graded = lambda x: F.exists(ran, lambda r: F.contains(r, x))
    rules = {
        "nothing_graded": F.size(ran) == 0,
        "not_model_output": F.exists(ran, lambda r: ~F.exists(F.coalesce("said", none), lambda t: F.contains(t, r))),
        "more_runs_than_turns": F.size(ran) > F.coalesce("n_turns", F.lit(0)),
        "graded_from_start": F.coalesce(F.col("begin") == 0, F.lit(False)),
        "observation_graded": F.exists(F.coalesce("seen", none), graded),
        "answer_not_graded": ~graded(F.coalesce("word", F.lit(""))) & (F.coalesce("word", F.lit("")) != ""),
    }
    return rows.select("conv_id", F.size(ran).alias("n_runs"), F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull()).alias("findings"))


def examples(tokens: DataFrame, max_len: int = 3072) -> DataFrame:
    """conv_id, n, n_graded and the label mask of sequences that aren't too long."""
    out = tokens.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("graded").alias("n_graded"), F.transform(F.array_sort(F.collect_list(F.struct("at", "graded"))), lambda x: F.when(x["graded"], F.lit(1)).otherwise(F.lit(IGNORE))).alias("labels"))
    return out.filter(F.col("n") <= max_len)


def pad(batches: DataFrame, pad_id: int = 0) -> DataFrame:
    """labels padded with IGNORE and a 0/1 attention mask, to the longest of the batch."""
    longest = F.max(F.size("labels")).over(Window.partitionBy("batch"))
    b = batches.withColumn("longest", longest)
    extra = F.col("longest") - F.size("labels")
    return b.select("conv_id", "batch", F.concat("labels", F.array_repeat(F.lit(IGNORE), extra)).alias("labels"), F.concat(F.array_repeat(F.lit(1), F.size("labels")), F.array_repeat(F.lit(0), extra)).alias("attention"))


def usage_cost(usage: DataFrame, prices: DataFrame, cached_rate: float = 0.25) -> DataFrame:
    """Spend per model of calls (model, prompt, cached, completion); an unknown model is free."""
    s = usage.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("prompt", "cached", "completion")]).join(prices, "model", "left")
    p_in, p_out = F.coalesce("price_in", F.lit(0.0)), F.coalesce("price_out", F.lit(0.0))
    fresh = F.greatest(F.lit(0), F.col("prompt") - F.col("cached"))
    return s.select("model", "prompt", "completion", F.round((fresh * p_in + F.col("cached") * p_in * cached_rate + F.col("completion") * p_out) / 1e6, 6).alias("usd"))


def waves_under_cap(waves: DataFrame, cap: float) -> DataFrame:
    """Waves (wave, cost) that start while the spend before them is below the cap."""
    before = F.coalesce(F.sum("cost").over(Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return waves.withColumn("before", before).filter(F.col("before") < cap)
