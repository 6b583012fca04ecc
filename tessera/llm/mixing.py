"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Everything is DataFrame operations. Each document gets a hash key; within a source the keys are cut into ranges
that hold a bounded number of documents each, so that a source of any size is spread over many tasks. The ranges'
totals are prefix-summed per source (a few rows each), and a document's place in its source is its range's offset
plus the running total inside the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import OWN, WORD, keep

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size.
MAX_EPOCHS = 3
#: Documents that a key range of a source holds on average.
ROWS_PER_RANGE = 5000
#: Hex digits of the key that choose its range.
DIGITS = 8


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows (source, source_size) with the target of each source added.

    Sources are ordered by code point, null last, and weigh weights[i % len]. The total of all sizes is shared by
    weight, a target stops at max_epochs times its source's size, and the excess goes to the others by weight until
    none is above. The shares' common level is found in closed form: with sources ordered by cap per weight, the
    first k are capped as long as the level that the others would share is above the next cap per weight; the level
    at which that ends is the greatest one below its cap, as capping more only lowers it.
    An empty source has target 0. One row per source, so the ordered windows see few rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    arr = F.array(*[F.lit(w) for w in weights])
    ranked = (
        sources.withColumn("w", F.element_at(arr, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))))
        .withColumn("share", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    )
    target = F.when(F.col("ratio") < F.col("share"), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("w"))
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), target).alias("target"))


def plan_mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, text, source) to (doc_id, source, size, source_size, target, taken): how many words the mix takes.

    A source gives floor(target) words: every document floor(target / source_size) times, then documents in key
    order once more until the rest is used up; the document at the cut gives its first words only. Null sources are
    one source. Null and empty texts have size 0 and are taken 0 times. Rows of equal doc_id and size are
    interchangeable, so reruns agree; a row without doc_id is placed by its text. Long texts count whole. Other columns,
    whatever their names, are neither read nor returned. An empty table gives no rows.
    """
    sized = keep(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce("text", F.lit(""))))).cast("binary")).alias("key"),
        ),
        "mix-sizes",
    )
    sources = keep(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_range)).cast("long")
    placed = source_targets(sources.select("source", "source_size"), weights, max_epochs).withColumnRenamed("source", "s1")
    plan = placed.join(sources.select(F.col("source").alias("s2"), ranges.alias("ranges")), F.col("s1").eqNullSafe(F.col("s2"))).drop("s2")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s1"))).drop("s1")
    at = F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(at * F.col("ranges") / (16**DIGITS)).cast("long"))
    per_range = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offsets = per_range.select(
        F.col("source").alias("s3"), F.col("range").alias("r3"),
        (F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")).alias("offset"),
    )
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s3")) & (F.col("range") == F.col("r3"))).drop("s3", "r3")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - full * F.col("source_size")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The mixed corpus: documents' columns, each row as often as the plan takes it.

    A document that is taken f times and a part keeps f whole rows and one row with its first words, joined by
    single blanks; there is at most one such document in a source. Rows that share a doc_id share a plan row by size.
    Documents without words (size 0), null texts among them, add nothing to a mix of words and are left out. All columns
    pass through, whatever their names. An empty table gives no rows.
    """
    names = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text", "source") else f"c{i}" for i, c in enumerate(names)])
    plan = plan_mix(docs.select("doc_id", "text", "source"), seed, **options)
    plan = plan.groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("taken")).alias(f"{OWN}taken"))
    plan = plan.select(F.col("doc_id").alias(f"{OWN}id"), F.col("source").alias(f"{OWN}source"), F.col("size").alias(f"{OWN}size"), f"{OWN}taken").filter(F.col(f"{OWN}size") > 0)
    rows = docs.withColumn(f"{OWN}n", word_count(F.col("text")))
    twins = Window.partitionBy("doc_id", "source", f"{OWN}n").orderBy("text")
    rows = rows.withColumn(f"{OWN}k", F.row_number().over(twins))
    on = F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & F.col("source").eqNullSafe(F.col(f"{OWN}source")) & (F.col(f"{OWN}n") == F.col(f"{OWN}size"))
    rows = rows.join(plan, on).withColumn(f"{OWN}t", F.element_at(f"{OWN}taken", F.col(f"{OWN}k")))
    part = F.col(f"{OWN}t") % F.col(f"{OWN}n")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), part.cast("int")), " ")
    whole = F.array_repeat(F.lit(False), F.expr(f"{OWN}t div {OWN}n").cast("int"))
    rows = rows.withColumn(f"{OWN}part", F.explode(F.concat(whole, F.when(part > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    text = F.when(F.col(f"{OWN}part"), cut).otherwise(F.col("text"))
    return rows.select(*[(text if c == "text" else F.col(c)).alias(name) for c, name in zip(docs.columns, names, strict=True)])


ORACLE = f"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (
  SELECT source, source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
         source_size * 3 AS cap, sum(source_size) OVER () AS total
  FROM src),
r AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS share FROM l),
g AS (SELECT source, source_size, least(cap::DOUBLE, CASE WHEN ratio < share THEN cap::DOUBLE ELSE share * w END) AS target FROM t),
p AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before,
         CASE WHEN g.source_size > 0 THEN floor(g.target)::BIGINT // g.source_size ELSE 0 END AS full_epochs
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (full_epochs * size + greatest(0, least(size, floor(target)::BIGINT - full_epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
