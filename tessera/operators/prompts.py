"""Opening prompts from a template, the swap of a recorded episode's first turn, and stored observations derived again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import snippet
from tessera.operators.episode import MAX_OBS
from tessera.operators.retrieval import last_of_title, read_by_title, search


@dataclass(frozen=True)
class Template:
    """The parts of an opening prompt; those for a citation rule and worked examples can be left out."""

    task: str = "Answer the question from the passages that the tools show. Take one action in each turn."
    tools: str = "- search[query]: titles and first words of the best passages\n- read[title]: a passage's whole text\n- answer[text]: your answer; this ends the episode"
    form: str = "Thought: one short sentence\nAction: tool[input]"
    cite: str = "Name after the answer, in square brackets, the title of every passage that supports it."
    plain: str = "Give only the answer."
    examples: tuple[str, ...] = ()

    def render(self, question: Column, citations: bool = True, n_examples: int = 0) -> Column:
        """The prompt of each question (null: empty)."""
        shown = [f"Example {i + 1}:\n{x}" for i, x in enumerate(self.examples[:n_examples])]
        head = "\n\n".join([self.task, f"Tools:\n{self.tools}", f"Form:\n{self.form}", self.cite if citations else self.plain, *shown])
        return F.concat(F.lit(f"{head}\n\nQuestion: "), F.coalesce(question, F.lit("")))


def rebuild_first(turns: DataFrame, prompts: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) whose first turn becomes a user turn with the text of prompts (conv_id, prompt)."""
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    t = turns.withColumn("first", first).join(prompts, "conv_id", "left")
    swap = F.col("first") & F.col("prompt").isNotNull()
    return t.select("conv_id", "turn", F.when(swap, "user").otherwise(F.col("role")).alias("role"), F.when(swap, F.col("prompt")).otherwise(F.col("text")).alias("text"))


def sentinels(before: DataFrame, after: DataFrame, marks: list[str]) -> DataFrame:
    """mark, n_before, n_after and verdict per mark, over turns' text: a mark never there before proves nothing (vacuous)."""
    marked = lambda df: df.select(F.explode(F.array(*map(F.lit, marks))).alias("mark"), "text").groupBy("mark").agg(F.count_if(F.contains("text", "mark")).alias("n"))
    if not marks:
        raise ValueError("no marks")
    a, b = marked(before).withColumnRenamed("n", "n_before"), marked(after).withColumnRenamed("n", "n_after")
    both = a.join(b, "mark", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    return both.withColumn("verdict", F.when(F.col("n_before") == 0, "vacuous").when(F.col("n_after") > 0, "still_there").otherwise("removed"))


def action_by_line(text: Column) -> Column:
    """struct<line, name, arg>: the first line that begins with `Action:`; name and arg only if it ends with a bracket."""
    line = F.try_element_at(F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x).startswith("Action:")), F.lit(1))
    body = F.trim(F.regexp_extract(line, r"(?s)Action:(.*)$", 1))
    at = F.instr(body, "[")
    whole = (at > 0) & body.endswith("]")
    return F.struct(line.alias("line"), F.when(whole, F.lower(F.trim(body.substr(F.lit(1), at - 1)))).alias("name"), F.when(whole, body.substr(at + 1, F.length(body) - at - 1)).alias("arg"))


def rederive(turns: DataFrame, passages: DataFrame, k: int = 3, max_obs: int = MAX_OBS) -> DataFrame:
    """Stored observations against those derived again from passages (task_id, pos, title, text).

    turns: conv_id, task_id, turn, role, text. Every assistant turn followed by a user turn whose first action line calls
    search or read is run again. Returns conv_id, turn, name, arg, stored, derived, finding: null, or
    observation_not_reproducible, action_not_at_line_start, task_not_found_in_pool.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("stored", F.lead("text").over(w))
    t = t.filter("role = 'assistant' and next_role = 'user' and contains(text, 'Action:')").withColumn("a", action_by_line(F.col("text")))
    t = t.select("conv_id", "task_id", "turn", "stored", "a.*").filter("line is null or name in ('search', 'read')")
    docs = last_of_title(passages.select("task_id", "pos", "title", "text"))
    asked = t.filter("name = 'read'").select("task_id", F.col("arg").alias("asked")).distinct()
    reads = read_by_title(asked, docs).join(docs.select("task_id", "title", "text"), ["task_id", "title"]).select("task_id", F.lit("read").alias("name"), F.col("asked").alias("arg"), F.concat(F.lit("["), "title", F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("seen"))
    queries = t.filter("name = 'search' and trim(arg) <> ''").select("task_id", "arg").distinct().select(F.struct("task_id", "arg").alias("qid"), "task_id", F.trim("arg").alias("query"))
    hits = search(queries, docs, k).join(docs.select("task_id", "title", "text"), ["task_id", "title"])
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(": "), snippet(F.coalesce("text", F.lit(""))))
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("h")).select("qid.task_id", F.lit("search").alias("name"), "qid.arg", F.concat(F.lit("search results:\n"), F.array_join(F.col("h.line"), "\n")).alias("seen"))
    pool = docs.select("task_id").distinct().withColumn("known", F.lit(True))
    none = F.when(F.col("name") == "read", F.concat(F.lit("error: read: no passage titled '"), "arg", F.lit("'."))).when(F.trim("arg") == "", "error: search: empty query.").otherwise("no results.")
    out = t.join(pool, "task_id", "left").join(reads.unionByName(lists), ["task_id", "name", "arg"], "left")
    out = out.withColumn("derived", F.when(F.col("line").isNotNull(), F.substring(F.coalesce("seen", none), 1, max_obs)))
    # What an error says beyond its first sentence is not compared.
    failed = F.col("seen").isNull() & F.col("derived").startswith("error:")
    same = F.when(failed, F.col("stored").startswith(F.col("derived"))).otherwise(F.col("stored") == F.col("derived"))
    finding = F.when(F.col("known").isNull(), "task_not_found_in_pool").when(F.col("line").isNull(), "action_not_at_line_start").when(~F.coalesce(same, F.lit(False)), "observation_not_reproducible")
    return out.select("conv_id", "turn", "name", "arg", "stored", "derived", finding.alias("finding"))
