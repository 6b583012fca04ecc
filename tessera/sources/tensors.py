"""Token ids and labels of unequal length as files that a trainer reads batch by batch.

Examples are dealt by length, so what lies together needs little padding. A task cuts its examples into batches of at
most so many places, padding included, and writes each batch as one row group of its own Parquet file; the index names
file and row group of every batch, so a reader takes any batch by one read of its bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.encoding import IGNORE
from tessera.session import bound_batches

INDEX = "file string, row_group int, n_rows int, longest int, n_tokens long, n_padded long"


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def cut(lengths: list[int], places: int) -> int:
    """How many of some examples, in ascending order of length, go into one batch: at least one, and as many as fit padded."""
    n = 0
    while n < len(lengths) and (n == 0 or (n + 1) * lengths[n] <= places):
        n += 1
    return n


def write_examples(examples: DataFrame, folder: str, config: dict | None = None, places: int = 16_384, parts: int | None = None) -> DataFrame:
    """(conv_id, input_ids, labels, ...) written below folder, a URI that all executors see; returns the index.

    Other columns go into meta, a JSON object per example; config is written beside the files. Rows without ids are an
    error of the caller. Repeated rows are examples of their own. A task that runs again writes its file again, and a
    file has its name only when it is complete. An empty table gives an index without rows.
    """
    spark = examples.sparkSession
    bound_batches(spark)
    folder = folder if ":/" in folder else f"file://{folder}"
    rest = [c for c in examples.columns if c not in ("conv_id", "input_ids", "labels")]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    rows = examples.select("conv_id", F.size("input_ids").alias("n"), "input_ids", "labels", meta.alias("meta"))
    by = ["n", F.xxhash64("conv_id", "meta")]
    dealt = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions("n", "conv_id", "meta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = _system(f"{folder}/data")
        system.create_dir(path, recursive=True)
        name = f"part-{context.partitionId():06d}.parquet"
        draft = f"{path}/_{name}.{context.taskAttemptId()}"
        index: list[tuple] = []
        writer, stream, held = None, None, None
        lengths: list[int] = []

        def put(n: int) -> None:
            nonlocal writer, stream, held, lengths
            if writer is None:
                stream = system.open_output_stream(draft)
                writer = pq.ParquetWriter(stream, held.schema, compression="zstd")
            group, own = held.slice(0, n), lengths[:n]
            writer.write_table(group, row_group_size=n)
            index.append((f"{folder}/data/{name}", len(index), n, own[-1], sum(own), n * own[-1] - sum(own)))
            held, lengths = held.slice(n), lengths[n:]

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            lengths += batch.column("n").to_pylist()
            while len(lengths) * lengths[-1] > places and (n := cut(lengths, places)) < len(lengths):
                put(n)
        while lengths:
            put(cut(lengths, places))
        if writer is not None:
            writer.close()
            stream.close()
            system.move(draft, f"{path}/{name}")
        columns = list(zip(*index, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

    dealt.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    spark.createDataFrame([(json.dumps(config or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_config(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/config").first()[0])


def read_batch(file: str, row_group: int, pad_id: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """One batch padded to its longest example: ids, labels, attention, and the examples' ids; one row group is read."""
    system, path = _system(file)
    with system.open_input_file(path) as f:
        table = pq.ParquetFile(f).read_row_group(row_group, columns=["conv_id", "input_ids", "labels"])
    rows = list(zip(table.column("input_ids").to_pylist(), table.column("labels").to_pylist(), strict=True))
    longest = max(len(i) for i, _ in rows)
    ids, labels, attention = np.full((len(rows), longest), pad_id), np.full((len(rows), longest), IGNORE), np.zeros((len(rows), longest), np.int64)
    for k, (i, lab) in enumerate(rows):
        ids[k, : len(i)], labels[k, : len(i)], attention[k, : len(i)] = i, lab, 1
    return ids, labels, attention, table.column("conv_id").to_pylist()


def batch_digests(index: DataFrame, pad_id: int = 0) -> DataFrame:
    """Every example as random reads of its batch give it: conv_id, file, row_group, n_tokens, n_graded, checksums.

    ids_crc32 and labels_crc32 are over the unpadded values as little-endian 32-bit integers.
    """
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, group in zip(batch.column("file").to_pylist(), batch.column("row_group").to_pylist(), strict=True):
                ids, labels, attention, names = read_batch(file, group, pad_id)
                n = attention.sum(1)
                crc = lambda x: [zlib.crc32(r[:k].astype("<i4").tobytes()) for r, k in zip(x, n, strict=True)]  # noqa: E731, B023
                yield pa.record_batch({"conv_id": names, "file": [file] * len(n), "row_group": np.full(len(n), group, np.int32), "n_tokens": n, "n_graded": (labels != IGNORE).sum(1), "ids_crc32": pa.array(crc(ids), pa.int64()), "labels_crc32": pa.array(crc(labels), pa.int64())})

    return index.mapInArrow(run, "conv_id long, file string, row_group int, n_tokens long, n_graded long, ids_crc32 long, labels_crc32 long")


def padding(index: DataFrame) -> DataFrame:
    """n_batches, n_examples, n_tokens and the share of places that are padding."""
    places = F.sum(F.col("n_rows").cast("long") * F.col("longest"))
    return index.agg(F.count(F.lit(1)).alias("n_batches"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_examples"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.round(F.sum("n_padded") / places, 6).alias("padding_share"))
