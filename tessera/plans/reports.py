"""Named queries over reports: intervals, split validation, evaluations written and summarised in one scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import selection as S
from tessera.operators import splits as P
from tessera.plans.catalogue import PAIRED, _arms, _rows, query, split_ranges
from tessera.session import shared_folder
from tessera.sources import evaluation as V

DRAWS = 200
_STEPS = " + ".join(f"(u >= {p!r})::INT" for p in S.POISSON)


@query(PAIRED + f""", pz AS (SELECT task_id AS key, y::INT::DOUBLE - x::INT::DOUBLE AS d FROM a JOIN b USING (task_id)),
u AS (SELECT draw, d, ('0x' || substring(md5((draw // 4) || ':' || key), ((draw % 4) * 8 + 1)::INT, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM pz, range({DRAWS}) r(draw)),
m AS (SELECT draw, round(sum(({_STEPS}) * d) / sum({_STEPS}), 6) AS m FROM u GROUP BY draw), o AS (SELECT list(m ORDER BY m) AS l FROM m)
SELECT (SELECT count(*)::BIGINT FROM pz) AS n, (SELECT round(avg(d), 6) FROM pz) AS delta, l[{int(DRAWS * 0.025) + 1}] AS low, l[{int(DRAWS * 0.975) + 1}] AS high FROM o""", chain=True)
def bootstrap_poisson(spark, d):
    a, b = _arms(spark, d)
    both = a.withColumnRenamed("correct", "x").join(b.withColumnRenamed("correct", "y"), "task_id")
    return S.poisson_bootstrap(both.select(F.col("task_id").alias("key"), (F.col("y").cast("double") - F.col("x").cast("double")).alias("d")), DRAWS)


@query("WITH l AS (SELECT l_returnflag AS flag, list(l_extendedprice ORDER BY l_extendedprice) AS l FROM lineitem GROUP BY 1) SELECT flag, q, l[floor(len(l) * q)::INT + 1] AS value FROM l, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) v(q)")
def index_quantiles_by_flag(spark, d):
    from tessera.plans.views import table

    of = S.index_quantiles_by(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.5, 0.9, 0.99])
    return of.withColumnsRenamed({"l_returnflag": "flag", "l_extendedprice": "value"})


#: The draw's ranges with three faults: train lacks its last ten, dev holds five of test, and two of test changed places.
FAULTS = """WITH o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS place FROM documents),
was AS (SELECT id, CASE WHEN place < 100 THEN 'train' WHEN place < 150 THEN 'dev' ELSE 'test' END AS split, place FROM o WHERE place < 200),
now AS (SELECT id, split, CASE place WHEN 160 THEN 161 WHEN 161 THEN 160 ELSE place END AS place FROM was WHERE place NOT BETWEEN 90 AND 99 UNION ALL SELECT id, 'dev', place FROM was WHERE place BETWEEN 150 AND 154)"""


@query(FAULTS + """, s AS (SELECT split, count(DISTINCT id) AS n FROM now GROUP BY split)
SELECT 'size' AS "check", split AS splits, n::BIGINT AS n, x::BIGINT AS expected, NULL::BIGINT AS example, n = x AS ok FROM s JOIN (VALUES ('train', 100), ('dev', 50), ('test', 50)) e(sp, x) ON sp = split
UNION ALL SELECT 'leak', a.split || '/' || b.split, count(DISTINCT id), NULL, min(id), false FROM now a JOIN now b USING (id) WHERE a.split < b.split GROUP BY ALL
UNION ALL SELECT 'moved', was.split, count(DISTINCT was.id), NULL, min(was.id), false FROM was LEFT JOIN now ON was.id = now.id AND was.split = now.split AND was.place = now.place WHERE now.id IS NULL GROUP BY ALL""")
def split_validation(spark, d):
    was = split_ranges(spark, d).select(F.col("doc_id").alias("id"), "split", "place")
    place = F.when(F.col("place") == 160, 161).when(F.col("place") == 161, 160).otherwise(F.col("place"))
    now = was.filter("place NOT BETWEEN 90 AND 99").withColumn("place", place).unionByName(was.filter("place BETWEEN 150 AND 154").withColumn("split", F.lit("dev")))
    return P.validate(now, {"train": 100, "dev": 50, "test": 50}, was)


_SUMS = {
    "correct_rate": "correct::INT", "mean_cite_f1": "f1", "mean_title_f1": "title_f1", "mean_read_before_cite": "read_before_cite", "mean_fabricated": "n_fabricated", "mean_n_steps": "n_steps", "mean_n_searches": "n_searches",
    "mean_n_reads": "n_reads", "mean_answer_words": "answer_words", "mean_hit_rate": "hit_rate", "calls_read_rate": "(n_reads > 0)::INT", "terminated_cleanly_rate": "done::INT", "zero_tool_call_rate": "(n_tool_calls = 0)::INT",
    "capped_rate": "(n_tool_calls >= 8)::INT", "answered_rate": "done::INT", "correct_and_cited_rate": "(bucket = 'correct_and_cited')::INT", **{f"pct_{b}": f"(bucket = '{b}')::INT" for b in V.BUCKETS},
}
SUMMARY = "count(*)::BIGINT AS n, " + ", ".join(f"round(avg(({c})::DOUBLE), 6) AS {n}" for n, c in _SUMS.items()) + ", " + ", ".join(f"count(*) FILTER (least(n_tool_calls, 8) = {k})::BIGINT AS hops_{k}" for k in range(9))


@query(f"SELECT arm, {SUMMARY} FROM rows GROUP BY arm", chain=True)
def evaluation_summary(spark, d):
    """Written arm by arm; each summary is what the write observed."""
    folder, rows = shared_folder(spark, "evaluation"), _rows(spark, d)
    for arm in ("base", "tuned"):
        V.write_arms(rows.filter(F.col("arm") == arm), folder, [arm])
    made = V.read_arms(spark, folder)
    names = list(V.measures())
    kinds = ", ".join(f"{n} {'long' if n == 'n' or n.startswith('hops') else 'double'}" for n in names)
    return spark.createDataFrame([(a, *[s[n] for n in names]) for a, s in sorted(made.items())], f"arm string, {kinds}")


@query(f"SELECT hops, {SUMMARY} FROM rows GROUP BY hops", chain=True)
def evaluation_by_hops(spark, d):
    return V.summarize(_rows(spark, d), "hops")


@query()
def evaluation_card(spark, d):
    folder = shared_folder(spark, "evaluation")
    made = V.write_arms(_rows(spark, d), folder, ["base", "tuned"], {"split": "dev"})
    lines = V.card(made, "adapter", "base model", {"split": "dev"})
    return spark.createDataFrame(list(enumerate(lines)), "at int, line string")
