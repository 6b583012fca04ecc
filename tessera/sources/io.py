"""Readers and writers: JSON lines, nested Parquet, question sets, checkpoint folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP = "struct<thought:string,call:struct<name:string,args:map<string,string>,raw:string>,observation:string,ok:boolean,error:string,parse_ok:boolean,retrieved_titles:array<string>>"
TRAJECTORY = f"task_id string, query string, gold_answer string, supporting_titles array<string>, steps array<{STEP}>, final_answer string, done boolean"
TASK = "task_id string, question string, gold_answer string, gold_aliases array<string>, supporting_titles array<string>, passages array<struct<title:string,text:string>>"


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "error").json(path)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories with a fixed schema; steps written before parse_ok and retrieved_titles existed get their defaults."""
    df = spark.read.schema(TRAJECTORY).json(path)
    fix = lambda s: s.withField("parse_ok", F.coalesce(s["parse_ok"], F.lit(True))).withField("retrieved_titles", F.coalesce(s["retrieved_titles"], F.array().cast("array<string>")))
    return df.withColumn("steps", F.transform("steps", fix))


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a log whose last line may be cut, and the lines that can't be read (column line)."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    rows = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.filter("r._bad is null").select("r.*").drop("_bad"), rows.filter("r._bad is not null").select(F.col("value").alias("line"))


def done_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


def paired_lists_to_tasks(raw: DataFrame, prefix: str) -> DataFrame:
    """Rows (idx, question, answer, context struct<title, sentences>, supporting_facts struct<title>) to TASK."""
    joined = F.transform(F.arrays_zip("context.title", "context.sentences"), lambda p: F.struct(p["title"].cast("string").alias("title"), F.concat_ws(" ", p["sentences"]).alias("text")))
    return raw.select(F.concat(F.lit(prefix), F.col("idx").cast("string")).alias("task_id"), "question", F.col("answer").alias("gold_answer"), F.array().cast("array<string>").alias("gold_aliases"), F.array_distinct(F.col("supporting_facts.title").cast("array<string>")).alias("supporting_titles"), joined.alias("passages"))


def pair_context_to_tasks(raw: DataFrame, prefix: str) -> DataFrame:
    """As above where context is array<struct<title, sentences>> and supporting_facts array<struct<title>>."""
    joined = F.transform("context", lambda p: F.struct(p["title"].cast("string").alias("title"), F.concat_ws(" ", p["sentences"]).alias("text")))
    return raw.select(F.concat(F.lit(prefix), F.col("idx").cast("string")).alias("task_id"), "question", F.col("answer").alias("gold_answer"), F.array().cast("array<string>").alias("gold_aliases"), F.array_distinct(F.transform("supporting_facts", lambda s: s["title"].cast("string"))).alias("supporting_titles"), joined.alias("passages"))


def hop_rows_to_tasks(raw: DataFrame) -> DataFrame:
    """Rows (id, question, answer, answer_aliases, paragraphs) to TASK with hops and n_hops. A title's k-th repeat in a
    question becomes 'title (k)', in the passages and among the supporting ones; aliases equal to the answer go."""
    flat = raw.select("id", F.posexplode("paragraphs").alias("pos", "p")).select("id", "pos", F.trim("p.title").alias("title"), F.col("p.paragraph_text").alias("text"), F.col("p.is_supporting").alias("sup"))
    k = F.row_number().over(Window.partitionBy("id", "title").orderBy("pos"))
    flat = flat.withColumn("k", k).withColumn("title", F.when(F.col("k") > 1, F.concat("title", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("title")))
    per = flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "text", "sup"))).alias("x"))
    per = per.select("id", F.transform("x", lambda r: F.struct(r["title"].alias("title"), r["text"].alias("text"))).alias("passages"), F.transform(F.filter("x", lambda r: r["sup"]), lambda r: r["title"]).alias("supporting_titles"))
    hops = F.split_part("id", F.lit("__"), F.lit(1))
    return raw.join(per, "id").select(F.col("id").alias("task_id"), "question", F.col("answer").alias("gold_answer"), F.filter("answer_aliases", lambda a: a != F.col("answer")).alias("gold_aliases"), "supporting_titles", "passages", hops.alias("hops"), F.coalesce(F.regexp_extract(hops, r"^(\d)", 1).try_cast("int"), F.lit(0)).alias("n_hops"))


def union_sources(sources: list[DataFrame], n: int, seed: int = 0) -> DataFrame:
    """Question sets as one, in stable shuffled order, cut to n."""
    from functools import reduce

    from tessera.operators.datasets import draw

    return draw(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources), "task_id", n, seed)


def to_trainer_rows(tasks: DataFrame, source: str) -> DataFrame:
    """The trainer's nested row shape: prompt, data_source, extra_info."""
    return tasks.select(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("prompt"), F.lit(source).alias("data_source"), F.struct(*[F.col(c) for c in tasks.columns]).alias("extra_info"))


def from_trainer_rows(rows: DataFrame) -> DataFrame:
    """Its inverse; missing lists are empty."""
    kinds = dict(rows.select("extra_info.*").dtypes)
    return rows.select("extra_info.*").select(*[F.coalesce(F.col(c), F.array().cast(t)).alias(c) if t.startswith("array") else F.col(c) for c, t in kinds.items()])


def checkpoint_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of folder's global_step_<n>/actor checkpoints, ascending: step."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    actor = [(n,) for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n + "/actor"))]
    df = spark.createDataFrame(actor, "name string").select(F.regexp_extract("name", r"global_step_(\d+)$", 1).try_cast("long").alias("step"))
    return df.filter("step is not null").orderBy("step")


def report_markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as Markdown table lines, in order of the first column: line."""
    return rows.orderBy(columns[0]).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("line"))


#: Bundled questions. Fixed values of this library's own making.
FIXTURES = [
    ("fx-1", "Who designed the bridge at Orlen?", "Mara Velt", ["M. Velt"], ["Orlen Bridge", "Mara Velt"], [("Orlen Bridge", "The Orlen Bridge was designed by Mara Velt."), ("Mara Velt", "Mara Velt was an engineer."), ("Orlen", "Orlen is a town."), ("Velt Prize", "A prize for bridges.")]),
    ("fx-2", "In which year did the Tarn mill open?", "1911", [], ["Tarn mill", "Tarn"], [("Tarn mill", "The Tarn mill opened in 1911."), ("Tarn", "Tarn is a river."), ("Mills", "Mills grind grain."), ("1911", "A year.")]),
    ("fx-3", "Is the harbour of Sell older than the Tarn mill?", "yes", ["Yes, it is"], ["Harbour of Sell", "Tarn mill"], [("Harbour of Sell", "The harbour of Sell was built in 1840."), ("Tarn mill", "The Tarn mill opened in 1911."), ("Sell", "Sell is a port."), ("Harbours", "Ships lie in harbours.")]),
    ("fx-4", "Which river runs below the bridge that Mara Velt designed?", "the Tarn", ["Tarn", "River Tarn"], ["Orlen Bridge", "Mara Velt", "Tarn"], [("Mara Velt", "Mara Velt designed the Orlen Bridge."), ("Orlen Bridge", "The Orlen Bridge spans the Tarn."), ("Tarn", "Tarn is a river."), ("Bridges", "Bridges span rivers.")]),
]


def fixtures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURES, TASK)
