"""Streaming forms: windowed means, de-duplicated resume, a keyed episode state, and the checkpoint watcher."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark, folder: str) -> DataFrame:
    """events as a file stream; folder holds the table's file or part files."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(folder)


def step_means(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean value and count per tumbling window and type; a window is final once the watermark has passed it."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def first_deliveries(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """At-least-once input with each key once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def episode_state(events: DataFrame, cap: int = 8) -> DataFrame:
    """user_id, n_turns, done: episodes closed by a purchase or at cap turns, from turns that arrive one at a time."""
    import pandas as pd

    def step(key, batches, state):
        n = state.get[0] if state.exists else 0
        rows = pd.concat([b for b in batches]).sort_values(["ts", "event_id"])
        out = []
        for kind in rows["event_type"]:
            n += 1
            if kind == "purchase" or n >= cap:
                out.append((key[0], n, kind == "purchase"))
                n = 0
        state.update((n,))
        yield pd.DataFrame(out, columns=["user_id", "n_turns", "done"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n_turns int, done boolean", "n int", "append", "NoTimeout")


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all that is there now into folder, and return its rows from there.

    In complete mode the last batch is the result; what restarts from the same folder goes on where it stopped.
    """
    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={k}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
    return rows.select(*stream.columns)


def watch_steps(steps: DataFrame, push: Callable[[int], None], folder: str):
    """Call push with the largest step of each batch that is above all earlier ones (column step).

    The mark of what was pushed is a table in folder, beside the stream's checkpoint, so a restart pushes nothing twice
    but for a push that was cut off before its mark was written.
    """
    def act(batch: DataFrame, k: int) -> None:
        spark, mark = batch.sparkSession, f"{folder}/mark"
        path = spark._jvm.org.apache.hadoop.fs.Path(mark)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        high = spark.read.schema("step long").parquet(mark).agg(F.max("step")).first()[0] if there else None
        top = batch.agg(F.max("step")).first()[0]
        if top is not None and (high is None or top > high):
            push(top)
            spark.createDataFrame([(top,)], "step long").coalesce(1).write.mode("append").parquet(mark)

    return steps.writeStream.foreachBatch(act).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
