"""Sinks of foreachBatch that a batch may reach twice: an append log that forgets no key, and rows that replace older ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append_new(folder: str, keys: list[str], order: list[str], log: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose key no earlier batch had go to folder/rows; of a key's rows in a batch the first by order.

    The keys are an index of their own in folder/keys, in buckets by their hash: a batch reads the buckets that its keys
    fall into, whatever their age, so a log that is replayed at any time adds nothing. Both tables have a part for each
    batch, replaced when the batch runs again, and a batch doesn't look at its own part: a batch that was cut off and
    runs again writes what it would have. Null keys are a key. buckets must stay the same for a folder.
    """
    def put(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        by = F.struct(*order, F.to_json(F.struct(*batch.columns)))
        rows = batch.groupBy(*[F.col(c).alias(f"key_{c}") for c in keys]).agg(F.min_by(F.struct(*batch.columns), by).alias("row"))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*[f"key_{c}" for c in keys]), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").parquet(f"{folder}/work-{log}")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/work-{log}")
        if exists(spark, f"{folder}/keys"):
            known = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in rows.drop('row', 'bucket').dtypes)}, bucket int, log string, batch long").option("basePath", f"{folder}/keys").parquet(f"{folder}/keys")
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]
            known = known.filter(F.col("bucket").isin(touched) & ~((F.col("log") == log) & (F.col("batch") == k))).drop("log", "batch")
            same = [F.col("n.bucket") == F.col("o.bucket"), *[F.col(f"n.key_{c}").eqNullSafe(F.col(f"o.key_{c}")) for c in keys]]
            rows = rows.alias("n").join(known.alias("o"), same, "left_anti")
        rows.select("row.*").write.mode("overwrite").parquet(f"{folder}/rows/log={log}/batch={k}")
        names = rows.drop("row").repartition("bucket")
        names.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/keys/log={log}/batch={k}")

    return put


def upsert(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in update mode: a batch's rows replace earlier ones of their keys; read them with latest."""
    def put(batch: DataFrame, k: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{folder}/rows/batch={k}")

    return put


def latest(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """The newest row of each key that upsert wrote."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def run(stream: DataFrame, put: Callable[[DataFrame, int], None], folder: str, mode: str = "append"):
    """Drain what is there now into a sink and return the finished query; a second call goes on where this one stopped."""
    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
