"""Episodes recorded as native function calls, and the causes of replies that could not be used.

A reply with one readable call acts; a reply without any ends the episode with its text (or, in the strict form, is a
failure); everything else is asked again. The fold is set-oriented: the first ending reply bounds an episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOOLS
from tessera.operators.episode import MAX_OBS, MAX_TURNS

#: The first complete call of a reply. Fixed value.
CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"


def native_reply(text: Column) -> Column:
    """struct<found, name, args> of a reply (null: empty).

    found is false without a complete call, with malformed JSON, or with arguments that are neither an object nor a
    string holding one; missing arguments are an empty object. The name is trimmed and lower-cased.
    """
    body = F.regexp_extract(F.coalesce(text, F.lit("")), CALL, 1)
    v = F.try_parse_json(body)
    raw = F.try_variant_get(v, "$.arguments", "variant")
    inner = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(F.try_variant_get(raw, "$", "string"))).otherwise(raw)
    readable = raw.isNull() | F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    name = F.lower(F.trim(F.coalesce(F.try_variant_get(v, "$.name", "string"), F.lit(""))))
    args = F.coalesce(F.try_variant_get(inner, "$", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.struct((v.isNotNull() & readable).alias("found"), name.alias("name"), args.alias("args"))


def reply_kind(reply: Column, text: Column, strict: bool = False) -> Column:
    """empty, plain_text, parse, answer_tool or call; strict knows no plain-text ending and calls those replies parse."""
    blank = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")) == ""
    none = F.lit("parse") if strict else F.when(blank, "empty").otherwise("plain_text")
    return F.when(~reply["found"], none).when(~reply["name"].isin(*TOOLS), "parse").when(reply["name"] == "answer", "answer_tool").otherwise("call")


def fold_native(turns: DataFrame, tools: DataFrame, max_turns: int = MAX_TURNS, strict: bool = False) -> DataFrame:
    """turns (ep, t from 1, text) and tools (ep, t, obs, ok, titles) to steps, at most max_turns + 1 of an episode.

    kind is native_reply's; thought is the text before the call; a call that tools doesn't know fails.
    """
    t = turns.filter(F.col("t") <= max_turns + 1).withColumn("r", native_reply(F.col("text")))
    t = t.withColumn("kind", reply_kind(F.col("r"), F.col("text"), strict))
    end = F.min(F.when(F.col("kind").isin("plain_text", "answer_tool"), F.col("t"))).over(Window.partitionBy("ep"))
    t = t.withColumn("t_end", end).filter("t_end is null or t <= t_end").join(tools.select("ep", "t", F.col("obs").alias("tool_obs"), F.col("ok").alias("tool_ok"), F.col("titles").alias("tool_titles")), ["ep", "t"], "left")
    kind, ran = F.col("kind"), F.col("kind") == "call"
    answer = F.when(kind == "plain_text", F.trim("text")).when(kind == "answer_tool", F.trim(F.coalesce(F.col("r.args")["text"], F.lit(""))))
    ok = F.coalesce(F.col("tool_ok"), F.lit(False))
    return t.select(
        "ep", "t", "kind", F.when(kind == "plain_text", "answer").when(ran | (kind == "answer_tool"), F.col("r.name")).alias("name"),
        F.when(ran | (kind == "answer_tool"), F.trim(F.regexp_extract("text", r"(?s)^(.*?)<tool_call>", 1))).otherwise("").alias("thought"),
        (~kind.isin("parse", "empty")).alias("parse_ok"), F.when(ran, ok).otherwise(answer.isNotNull()).alias("ok"),
        F.when(kind.isin("parse", "empty"), kind).when(ran & ~ok, "tool_error").alias("error"),
        F.when(ran, F.substring("tool_obs", 1, MAX_OBS)).otherwise(answer).alias("obs"),
        F.when(ran & ok, F.col("tool_titles")).otherwise(F.array().cast("array<string>")).alias("titles"),
    )


def native_episodes(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per task's ep: finish_mode (plain_text, answer_tool, round_limit, or dead without steps), counters, final_answer."""
    ends = F.col("kind").isin("plain_text", "answer_tool")
    per = steps.groupBy("ep").agg(
        F.max(F.when(ends, F.col("kind"))).alias("finish"), F.count(F.lit(1)).alias("n_steps"), F.count_if(~F.col("parse_ok")).alias("n_retries"),
        F.count_if((F.col("thought") != "") & F.col("parse_ok")).alias("n_thoughts"), F.max_by(F.when(ends, F.col("obs")), F.when(ends, F.col("t"))).alias("final_answer"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tasks.select("ep").join(per, "ep", "left").select("ep", F.coalesce("finish", F.when(F.col("n_steps") > 0, "round_limit").otherwise("dead")).alias("finish_mode"), zero("n_steps"), zero("n_retries"), zero("n_thoughts"), "final_answer")


def bracket_cause(parse_ok: Column, text: Column) -> Column:
    """Why a bracket-style reply did not parse."""
    raw = F.coalesce(text, F.lit(""))
    return F.when(parse_ok, "parsed_ok").when(raw.contains("Action:"), "action_line_present_but_rejected").when(raw.contains("Thought:"), "thought_only_no_action").when(raw.rlike(r"(?U)\S"), "prose_no_react_syntax").otherwise("model_returned_empty_string")


def native_cause(text: Column, finish_reason: Column, stop_reason: Column) -> Column:
    """Why a function-call reply could not be used; finish_reason is length where the token limit cut it."""
    raw, reply, cut = F.coalesce(text, F.lit("")), native_reply(text), F.coalesce(finish_reason == "length", F.lit(False))
    stop = F.coalesce(F.concat(F.lit("'"), stop_reason, F.lit("'")), F.lit("None"))
    called = F.when(~reply["found"], "malformed_json_in_tool_call").when(reply["name"].isin(*TOOLS), "parsed_ok").otherwise(F.concat(F.lit("unknown_tool:"), reply["name"]))
    unclosed = F.when(cut, "tool_call_truncated_by_length").otherwise(F.concat(F.lit("tool_call_unclosed(stop="), stop, F.lit(")")))
    return F.when(raw.rlike(CALL), called).when(raw.contains("<tool_call>"), unclosed).when(cut, "prose_truncated_by_length").otherwise("plain_prose_no_tool_call")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays; 0 if either is null."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(a.isNull() | b.isNull(), F.lit(0)).when(at > 0, at.cast("int") - 1).otherwise(n)


def prefix_breaks(steps: DataFrame) -> DataFrame:
    """steps (ep, t, prompt, completion) whose prompt does not begin with all ids of the step before.

    Null ids are empty. Returns ep, t, n_before, n_prompt and diverges_at, the place of the first difference.
    """
    empty = F.array().cast("array<int>")
    full = F.concat(F.coalesce("prompt", empty), F.coalesce("completion", empty))
    s = steps.withColumn("before", F.lag(full).over(Window.partitionBy("ep").orderBy("t"))).withColumn("prompt", F.coalesce("prompt", empty)).filter("before is not null")
    s = s.withColumn("diverges_at", common_prefix(F.col("before"), F.col("prompt")))
    return s.filter(F.col("diverges_at") < F.size("before")).select("ep", "t", F.size("before").alias("n_before"), F.size("prompt").alias("n_prompt"), "diverges_at")
