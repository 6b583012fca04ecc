"""BM25 over passages that are grouped by question, or over one corpus.

tasks' passages are rows (task_id, pos, title, text). An index is three tables; scores come from an equi-join of query
tokens with postings, so passages without a query token never meet the ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bm25_tokens

K1, B = 1.5, 0.75


def last_of_title(passages: DataFrame) -> DataFrame:
    """One passage per (task_id, title): the last one."""
    w = Window.partitionBy("task_id", "title").orderBy(F.desc("pos"))
    return passages.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def suffix_repeated_titles(passages: DataFrame) -> DataFrame:
    """The k-th repeat of a title in a task becomes 'title (k)'."""
    w = Window.partitionBy("task_id", "title").orderBy("pos")
    k = F.row_number().over(w)
    return passages.withColumn("title", F.when(k > 1, F.concat("title", F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col("title")))


#: Distinct query tokens up to which they are sent to every task; more are joined by shuffling.
MOST_SENT = 200_000


def index(passages: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """postings (task_id, title, token, tf, dl) and stats (task_id, n, avgdl) of passages with distinct titles.

    With wanted (task_id, token), distinct, only the postings of those tokens are made; stats are of all passages.
    """
    docs = passages.select("task_id", "title", bm25_tokens(F.concat_ws(" ", "title", "text")).alias("tokens"))
    docs = docs.select("task_id", "title", F.size("tokens").alias("dl"), "tokens")
    stats = docs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    flat = docs.select("task_id", "title", "dl", F.explode("tokens").alias("token"))
    if wanted is not None:
        few = wanted.limit(MOST_SENT + 1).count() <= MOST_SENT
        flat = flat.join(F.broadcast(wanted) if few else wanted, ["task_id", "token"], "left_semi")
    return flat.groupBy("task_id", "title", "dl", "token").agg(F.count(F.lit(1)).alias("tf")), stats


def search(questions: DataFrame, passages: DataFrame, k: int = 3, k1: float = K1, b: float = B) -> DataFrame:
    """questions (qid, task_id, query) to the k best passages: qid, task_id, title, score, rank. Query tokens count as often
    as they stand in the query; ties go to the smaller title. Tokens that no question has are dropped before any shuffle."""
    query = questions.select("qid", "task_id", F.explode(bm25_tokens(F.col("query"))).alias("token")).groupBy("qid", "task_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    postings, stats = index(passages, query.select("task_id", "token").distinct())
    df = postings.groupBy("task_id", "token").agg(F.count(F.lit(1)).alias("df"))
    hit = query.join(df, ["task_id", "token"]).join(postings, ["task_id", "token"]).join(stats, "task_id")
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = hit.groupBy("qid", "task_id", "title").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "title")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def read_by_title(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """asked (task_id, asked) with title: the exact one, else the only one equal to it without case, else null."""
    titles = passages.select("task_id", "title").distinct()
    exact = titles.select("task_id", F.col("title").alias("asked"), F.col("title").alias("exact"))
    loose = titles.groupBy("task_id", F.lower("title").alias("low")).agg(F.min("title").alias("loose"), F.count(F.lit(1)).alias("m")).filter("m = 1")
    asked = asked.withColumn("low", F.lower(F.trim("asked")))
    return asked.join(exact, ["task_id", "asked"], "left").join(loose, ["task_id", "low"], "left").select("task_id", "asked", F.coalesce("exact", "loose").alias("title"))
