"""Named queries over the library's own sources, on files that are written from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.catalogue import query
from tessera.plans.views import table
from tessera.session import shared_folder
from tessera.sources import tasksets as T
from tessera.sources.io import union_sources

#: Five documents are a question's passages; the second and the last one support its answer.
_SQL = """WITH d AS (SELECT doc_id // 5 AS q, doc_id, {title} AS title, {text} AS text, doc_id % 5 IN (1, 4) AS sup, row_number() OVER (PARTITION BY doc_id // 5, lang ORDER BY doc_id) AS k FROM documents),
p AS (SELECT q, max(doc_id) AS last, list(CASE WHEN {suffix} AND k > 1 THEN title || ' (' || k || ')' ELSE title END ORDER BY doc_id) AS titles, list(text ORDER BY doc_id) AS texts,
  list(CASE WHEN {suffix} AND k > 1 THEN title || ' (' || k || ')' ELSE title END ORDER BY doc_id) FILTER (sup) AS sup FROM d GROUP BY q)"""


def _questions(spark, d):
    docs = table(spark, d, "documents").withColumn("q", F.expr("doc_id div 5"))
    row = F.struct("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 5).isin(1, 4).alias("sup"))
    return docs.groupBy("q").agg(F.array_sort(F.collect_list(row)).alias("r"), F.max("doc_id").alias("last"))


def _written(spark, rows, name):
    folder = shared_folder(spark, name)
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)
    return folder


def _load(spark, folder, shape, dataset):
    T.register(spark)
    return spark.read.format("tessera_tasks").option("path", folder).option("shape", shape).option("dataset", dataset).load()


def _paired(spark, d):
    r = F.col("r")
    context = F.struct(F.transform(r, lambda x: x["lang"]).alias("title"), F.transform(r, lambda x: F.split(x["text"], "\n")).alias("sentences"))
    facts = F.struct(F.transform(F.filter(r, lambda x: x["sup"]), lambda x: x["lang"]).alias("title"))
    rows = _questions(spark, d).select(F.col("q").alias("id"), F.concat(F.lit("question "), "q").alias("question"), F.concat(F.lit("answer "), "last").alias("answer"), context.alias("context"), facts.alias("supporting_facts"))
    return _load(spark, _written(spark, rows, "paired"), "paired_lists", "paired")


def _hops(spark, d):
    paragraphs = F.transform("r", lambda x: F.struct(x["lang"].alias("title"), x["text"].alias("paragraph_text"), x["sup"].alias("is_supporting")))
    name = F.concat((F.col("q") % 3 + 2).cast("string"), F.lit("hop__"), "q")
    rows = _questions(spark, d).select(name.alias("id"), F.concat(F.lit("question "), "q").alias("question"), F.concat(F.lit("answer "), "last").alias("answer"), F.array(F.concat(F.lit("answer "), "last"), F.lit("other")).alias("answer_aliases"), paragraphs.alias("paragraphs"))
    return _load(spark, _written(spark, rows, "hops"), "hop_paragraphs", "hops")


def _digest(tasks):
    of = lambda c: F.transform("passages", lambda p: p[c])
    return tasks.select("task_id", "question", "gold_answer", F.array_join("gold_aliases", "|").alias("aliases"), F.array_join("supporting_titles", "|").alias("supporting"), F.array_join(of("title"), "|").alias("titles"), F.md5(F.array_join(of("text"), "\x01").cast("binary")).alias("texts_md5"), "n_hops")


_PAIRED_SQL = _SQL.format(title="lang", text="replace(coalesce(text, ''), chr(10), ' ')", suffix="false")
_PAIRED_ROWS = "SELECT 'paired-' || q AS task_id, 'question ' || q AS question, 'answer ' || last AS gold_answer, '' AS aliases, CASE WHEN sup IS NULL THEN '' WHEN len(sup) = 2 AND sup[1] = sup[2] THEN sup[1] ELSE array_to_string(sup, '|') END AS supporting, array_to_string(titles, '|') AS titles, md5(array_to_string(texts, chr(1))) AS texts_md5, NULL::INT AS n_hops FROM p"


@query(f"{_PAIRED_SQL} {_PAIRED_ROWS}")
def source_paired_lists(spark, d):
    return _digest(_paired(spark, d))


_HOPS_SQL = _SQL.format(title="lang", text="coalesce(text, '')", suffix="true")
_HOPS_ROWS = "SELECT (q % 3 + 2) || 'hop__' || q AS task_id, 'question ' || q AS question, 'answer ' || last AS gold_answer, 'other' AS aliases, array_to_string(coalesce(sup, []), '|') AS supporting, array_to_string(titles, '|') AS titles, md5(array_to_string(texts, chr(1))) AS texts_md5, (q % 3 + 2)::INT AS n_hops FROM p WHERE q % 3 + 2 >= 3"


@query(f"{_HOPS_SQL} {_HOPS_ROWS}")
def source_hop_paragraphs(spark, d):
    return _digest(_hops(spark, d).filter("n_hops >= 3"))


@query("WITH t AS (SELECT DISTINCT 'paired-' || (doc_id // 5) AS task_id FROM documents UNION ALL SELECT DISTINCT (doc_id // 5 % 3 + 2) || 'hop__' || (doc_id // 5) FROM documents) SELECT task_id, split_part(task_id, '-', 1) = 'paired' AS paired FROM t ORDER BY md5('0:' || task_id), task_id LIMIT 50")
def source_union(spark, d):
    """Both sets as one in stable shuffled order, cut to 50: a draw."""
    return union_sources([_paired(spark, d), _hops(spark, d)], 50).select("task_id", (F.col("dataset") == "paired").alias("paired"))


@query("SELECT n_nationkey::BIGINT AS step FROM nation WHERE n_nationkey % 3 <> 0")
def checkpoint_folder_steps(spark, d):
    """A folder with a checkpoint for each nation; every third one has no actor."""
    from pyarrow import fs

    T.register(spark)
    folder = shared_folder(spark, "run")
    system, path = fs.FileSystem.from_uri(folder)
    for (k,) in table(spark, d, "nation").select("n_nationkey").collect():
        system.create_dir(f"{path}/global_step_{k}/{'critic' if k % 3 == 0 else 'actor'}", recursive=True)
    return spark.read.format("tessera_checkpoints").option("path", folder).load()
