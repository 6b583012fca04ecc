"""Proof that a partition of questions is what it claims to be, by one aggregate over the ids that were really loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, LEAK, MOVED = "size", "leak", "moved"


def validate(splits: DataFrame, expected: dict[str, int], frozen: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """splits (id, split, place) to a report: check, splits, n, expected, example, ok.

    size: distinct ids of a split against the expected number; a split that has no row, or that nobody expects, is there
    too. leak: ids that two splits share, with the least one, for each pair that shares any. moved: places of frozen
    (id, split, place), an earlier draw, at which the id no longer stands, by split; a longer draw moves none.

    An id is aggregated once with all its splits and places, so sizes, leaks and moves come from the same rows. Null ids
    are left out; repeated rows count once.
    """
    spark = splits.sparkSession
    spot = F.struct("split", F.col("place").cast("long").alias("place"))
    rows = splits.select(F.col(id_col).alias("id"), spot.alias("now"), F.lit(None).cast("struct<split:string,place:bigint>").alias("was"))
    if frozen is not None:
        rows = rows.unionByName(frozen.select(F.col(id_col).alias("id"), F.lit(None).cast("struct<split:string,place:bigint>").alias("now"), spot.alias("was")))
    per = rows.filter("id is not null").groupBy("id").agg(F.collect_set("now").alias("now"), F.collect_set("was").alias("was"))
    names = F.array_sort(F.array_distinct(F.transform("now", lambda s: s["split"])))
    key = lambda check, of: F.struct(F.lit(check).alias("check"), of.alias("splits"))
    pairs = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b > a), lambda b: F.concat(a, F.lit("/"), b))))
    moved = F.transform(F.array_except("was", "now"), lambda s: s["split"])
    keys = F.concat(F.transform(names, lambda s: key(SIZE, s)), F.transform(pairs, lambda p: key(LEAK, p)), F.transform(moved, lambda s: key(MOVED, s)))
    found = per.select("id", F.explode(keys).alias("k")).groupBy("k.check", "k.splits").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("example"))
    wanted = spark.createDataFrame([(SIZE, s, n) for s, n in expected.items()], "check string, splits string, expected long")
    report = found.join(F.broadcast(wanted), ["check", "splits"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    ok = F.when(F.col("check") == SIZE, F.coalesce(F.col("n") == F.col("expected"), F.lit(False))).otherwise(F.lit(False))
    return report.select("check", "splits", "n", "expected", F.when(F.col("check") != SIZE, F.col("example")).alias("example"), ok.alias("ok"))


def require(report: DataFrame) -> None:
    """Raise with all findings of a report that has any."""
    bad = report.filter(~F.col("ok")).orderBy("check", "splits").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']} {r['splits']}: {r['n']}" + (f" of {r['expected']}" if r["check"] == SIZE else f", such as {r['example']}") for r in bad))
