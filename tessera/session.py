"""Spark session defaults of this library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(name: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow. master and shuffle_partitions are left to the cluster if not given."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            settings |= {"spark.driver.memory": "6g", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tessera-warehouse-"), "spark.driver.host": "127.0.0.1"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows and bytes of an Arrow batch, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers hold small whatever the rows' lengths are.

    These two session settings are only lowered, and stay so, as they count when a result is computed.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(name)
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which every executor sees; a local master may do without it (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        shared = tempfile.mkdtemp(prefix="tessera-shared-")
    shared = shared if ":/" in shared else f"file://{shared}"
    return f"{shared}/{name}-{uuid.uuid4().hex}"
