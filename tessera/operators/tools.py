"""Tool calls run as a set: argument checks, passages shown, and every failure as an observation with its kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import snippet
from tessera.operators.retrieval import last_of_title, read_by_title, search


#: What an argument without a value reads as. Fixed value.
NOTHING = "None"


@dataclass(frozen=True)
class Tool:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    about: str = ""

    def line(self) -> str:
        """The tool's line of a menu; optional arguments have a question mark."""
        return f"- {self.name}({', '.join([*self.required, *(f'{a}?' for a in self.optional)])}): {self.about}"


TOOLS = (
    Tool("search", ("query",), ("k",), "titles and first words of the best passages"),
    Tool("read", ("title",), (), "a passage's whole text"),
    Tool("answer", ("text",), (), "your answer; this ends the episode"),
)


def menu(names: list[str]) -> str:
    """Lines of the named tools in that order; unknown names have none."""
    known = {t.name: t for t in TOOLS}
    return "\n".join(known[n].line() for n in names if n in known)


def menu_of(names: Column) -> Column:
    """menu of an array column: the line of each known name, in the array's order; null for null."""
    lines = F.create_map(*[x for t in TOOLS for x in (F.lit(t.name), F.lit(t.line()))])
    return F.array_join(F.filter(F.transform(names, lambda n: F.try_element_at(lines, n)), lambda x: x.isNotNull()), "\n")


def _problem(name: Column, args: Column) -> Column:
    """struct<error, obs> of what is wrong with a call before it runs, else null; args is a map."""
    out = F.lit(None).cast("struct<error:string,obs:string>")
    for t in TOOLS:
        missing = F.array_except(F.array(*map(F.lit, t.required)), F.map_keys(args))
        extra = F.array_sort(F.array_except(F.map_keys(args), F.array(*map(F.lit, t.required + t.optional))))
        say = lambda error, what, names, t=t: F.struct(F.lit(error).alias("error"), F.concat(F.lit(f"error: {t.name} {what}: "), F.array_join(names, ", ")).alias("obs"))
        found = F.when(F.size(missing) > 0, say("missing_arg", "missing required arg(s)", missing)).when(F.size(extra) > 0, say("unexpected_arg", "got unexpected arg(s)", extra))
        out = F.when(name == t.name, found).otherwise(out)
    unknown = F.struct(F.lit("unknown_tool").alias("error"), F.concat(F.lit("error: unknown tool '"), name, F.lit("'")).alias("obs"))
    return F.when(name.isin(*[t.name for t in TOOLS]), out).otherwise(unknown)


def execute(calls: DataFrame, passages: DataFrame, k: int = 3) -> DataFrame:
    """calls (id, task_id, name, args map<string,string>) run on passages (task_id, pos, title, text).

    Returns id, name, ok, error (unknown_tool, missing_arg, unexpected_arg, tool_error, internal_error or null), obs and
    titles. A call never fails the job. search and read are joins with the passages of their task; a search's k must be
    a number. Null names and args are empty; an argument that is there without a value is the text NOTHING, so a k without
    one is no number.
    """
    given = F.transform_values(F.coalesce("args", F.create_map().cast("map<string,string>")), lambda _, v: F.coalesce(v, F.lit(NOTHING)))
    c = calls.select("id", "task_id", F.coalesce("name", F.lit("")).alias("name"), given.alias("args"))
    c = c.withColumn("bad", _problem(F.col("name"), F.col("args")))
    docs = last_of_title(passages.select("task_id", "pos", "title", "text"))
    good = c.filter("bad is null")
    asked = good.filter("name = 'read'").select("task_id", F.col("args")["title"].alias("asked")).distinct()
    shown = read_by_title(asked, docs).join(docs.select("task_id", "title", "text"), ["task_id", "title"])
    shown = shown.select("task_id", F.lit("read").alias("name"), F.col("asked").alias("arg"), F.lit(None).cast("int").alias("k"), F.concat(F.lit("["), "title", F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("seen"), F.array("title").alias("found"))
    wanted = F.coalesce(F.col("args")["k"].try_cast("int"), F.lit(k))
    queries = good.filter("name = 'search' and trim(args['query']) <> '' and (args['k'] is null or try_cast(args['k'] as int) is not null)")
    queries = queries.select("task_id", F.col("args")["query"].alias("arg"), wanted.alias("k")).distinct()
    most = queries.agg(F.max("k")).first()[0] or 0
    hits = search(queries.select(F.struct("task_id", "arg", "k").alias("qid"), "task_id", F.col("arg").alias("query")), docs, max(1, most))
    hits = hits.filter("rank <= qid.k").join(docs.select("task_id", "title", "text"), ["task_id", "title"])
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(": "), snippet(F.coalesce("text", F.lit(""))))
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title", line.alias("line")))).alias("h"))
    lists = lists.select("qid.task_id", F.lit("search").alias("name"), "qid.arg", "qid.k", F.concat(F.lit("search results:\n"), F.array_join(F.col("h.line"), "\n")).alias("seen"), F.col("h.title").alias("found"))
    arg = F.when(F.col("name") == "read", F.col("args")["title"]).when(F.col("name") == "search", F.col("args")["query"])
    c = c.withColumn("arg", arg).withColumn("wanted", F.when(F.col("name") == "search", wanted))
    out = c.alias("c").join(shown.unionByName(lists).alias("s"), F.expr("c.bad is null and c.task_id = s.task_id and c.name = s.name and c.arg = s.arg and c.wanted <=> s.k"), "left")
    out = out.select("c.id", "c.name", "c.args", "c.bad", "c.arg", "s.seen", "s.found")
    text, number = F.trim(F.col("args")["text"]), F.col("args")["k"].isNull() | F.col("args")["k"].try_cast("int").isNotNull()
    error = (
        F.when(F.col("bad").isNotNull(), F.col("bad.error"))
        .when((F.col("name") == "search") & ~number, "internal_error")
        .when((F.col("name") == "search") & (F.trim("arg") == ""), "tool_error")
        .when((F.col("name") == "read") & F.col("seen").isNull(), "tool_error")
        .when((F.col("name") == "answer") & (text == ""), "tool_error")
    )
    said = (
        F.when(F.col("bad").isNotNull(), F.col("bad.obs"))
        .when(F.col("error") == "internal_error", "error: internal (k is no number)")
        .when(F.col("error").isNotNull() & (F.col("name") == "read"), F.concat(F.lit("error: read: no passage titled '"), "arg", F.lit("'.")))
        .when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "name", F.lit(": empty "), F.when(F.col("name") == "answer", "answer").otherwise("query"), F.lit(".")))
        .when(F.col("name") == "answer", text)
        .otherwise(F.coalesce("seen", F.lit("no results.")))
    )
    out = out.withColumn("error", error).withColumn("obs", said)
    return out.select("id", "name", F.col("error").isNull().alias("ok"), "error", "obs", F.coalesce(F.when(F.col("error").isNull(), F.col("found")), F.array().cast("array<string>")).alias("titles"))
