"""Column functions over answers, titles, actions and passages. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation deleted from answers. Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TOOLS = ("search", "read", "answer")
#: The action line of a turn. Fixed value.
ACTION = r"(?md)Action:\s*([a-zA-Z_]+)\s*\[(.*)\]\s*$"
#: Text after any of these at a line's start was not meant by the policy. Fixed value.
STOP = r"\n(?:Thought:|search results:|\[)"
DIGITS = r"^\d+$"


def norm_title(t: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def bm25_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_answer(s: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single blanks."""
    low = F.translate(F.lower(F.coalesce(s, F.lit(""))), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def answer_tokens(s: Column) -> Column:
    return F.filter(F.split(normalize_answer(s), " "), lambda x: x != "")


def exact_match(pred: Column, golds: Column) -> Column:
    return F.exists(F.filter(golds, lambda g: g.isNotNull()), lambda g: normalize_answer(g) == normalize_answer(pred))


def token_f1(pred: Column, golds: Column) -> Column:
    """Best F1 over golds by multiset overlap; both empty is 1, one empty 0."""
    p = answer_tokens(pred)

    def one(gold: Column) -> Column:
        g = answer_tokens(gold)
        count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
        same = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(g, t))).cast("double")
        f1 = 2 * same / F.greatest(F.size(p) + F.size(g), F.lit(1))
        return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(f1)

    return F.coalesce(F.array_max(F.transform(F.filter(golds, lambda g: g.isNotNull()), one)), F.lit(0.0))


def share_in(tokens: Column, other: Column) -> Column:
    """Share of tokens, repeats counted, that stand in other; 0 without tokens."""
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(F.size(F.filter(tokens, lambda t: F.array_contains(other, t))) / F.greatest(F.size(tokens), F.lit(1)))


def answer_recall(pred: Column, context: Column) -> Column:
    return share_in(answer_tokens(pred), answer_tokens(context))


def align_overlap(claim: Column, passage: Column) -> Column:
    return share_in(bm25_tokens(claim), bm25_tokens(passage))


def snippet(t: Column, size: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("…")))


def sentences(answer: Column) -> Column:
    return F.split(F.trim(F.coalesce(answer, F.lit(""))), r"(?U)(?<=[.!?])\s+")


def strip_citations(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\[[^\]]+?\]", ""))


def citations(answer: Column) -> Column:
    """array<struct<title, claim>>: bracketed titles of each sentence, without empty and all-digit ones."""
    marks = lambda s: F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"\[([^\]]+?)\]"), F.lit(1)), lambda t: F.trim(t)), lambda t: (t != "") & ~t.rlike(DIGITS))
    return F.flatten(F.transform(sentences(answer), lambda s: F.transform(marks(s), lambda t: F.struct(t.alias("title"), strip_citations(s).alias("claim")))))


def uncited_claims(answer: Column) -> Column:
    """Sentences with content and no bracketed title; a number in brackets is no title."""
    cited = lambda s: F.exists(F.transform(F.regexp_extract_all(s, F.lit(r"\[([^\]]+?)\]"), F.lit(1)), lambda t: F.trim(t)), lambda t: (t != "") & ~t.rlike(DIGITS))
    return F.size(F.filter(sentences(answer), lambda s: (strip_citations(s) != "") & ~cited(s)))


def parse_action(text: Column) -> Column:
    """struct<thought, name, payload, parse_ok> of an assistant turn: its first action line, greedy to the last bracket."""
    found = text.rlike(ACTION)
    name = F.lower(F.regexp_extract(text, ACTION, 1))
    thought = F.trim(F.regexp_extract(text, r"(?s)Thought:\s*(.*?)(?:\nAction:|\z)", 1))
    return F.struct(thought.alias("thought"), F.when(found, name).alias("name"), F.when(found, F.trim(F.regexp_extract(text, ACTION, 2))).alias("payload"), (found & name.isin(*TOOLS)).alias("parse_ok"))


def parse_native_call(text: Column) -> Column:
    """struct<name, arguments, ok> of the first <tool_call>; arguments may be an object or a string that holds one."""
    body = F.regexp_extract(text, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    name, raw = F.get_json_object(body, "$.name"), F.get_json_object(body, "$.arguments")
    args = F.from_json(raw, "map<string,string>")
    return F.struct(name.alias("name"), args.alias("arguments"), (name.isNotNull() & args.isNotNull()).alias("ok"))


def turn_stop_cut(text: Column) -> Column:
    return F.element_at(F.split(text, STOP, 2), 1)


def parse_judge_score(text: Column) -> Column:
    """First number of a judge's reply, held between 0 and 10; 0 without a number."""
    number = F.regexp_extract(text, r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(number, F.lit(0.0))))


def read_lines(text: Column) -> Column:
    """Titles of `Action: read[...]` lines, the line parser that tiering uses."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda t: F.trim(t)), lambda x: x.startswith("Action: read[") & x.endswith("]"))
    return F.transform(lines, lambda x: F.trim(x.substr(F.lit(14), F.length(x) - 14)))


def ramp(step: Column, start: float, end: float, low: float, high: float) -> Column:
    """low until start, high from end on, linear between."""
    part = low + (step - start) / max(1, end - start) * (high - low)
    return F.when(step <= start, F.lit(float(low))).when(step >= end, F.lit(float(high))).otherwise(part)
