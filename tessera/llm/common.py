"""What the operators of this package share: scratch space, Arrow passes over text, input shaping."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of every column that an operator adds beside a caller's own columns.
OWN = "__tsr_"
#: Words everywhere are maximal runs of bytes other than these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: hot_keys: shares of an average partition above which a key is hot, and rows that never make one hot.
SHARE, MIN_HOT = 4, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees, as a URI; no setting is changed.

    Where that is unset, the folder that the context checkpoints to is taken; a local master without either gets a
    temporary one (tests), and any other master is an error.
    """
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir().isDefined():
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    folder = folder or context.getCheckpointDir().get()
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


#: Folders of this process's applications, which go when Python ends, whether their session was stopped before or not.
_FOLDERS: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one, named after the application that owns it. It goes when Python ends."""
    if not _FOLDERS:
        atexit.register(clean)
    _FOLDERS.add(_folder(spark))
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*kept: DataFrame) -> None:
    """Delete tables of keep that nothing will read any more, also not to make lost parts again."""
    for df in kept:
        _delete(df.sparkSession, df._tessera_path)


def clean() -> None:
    """Delete all scratch folders of this process; results that were not read or written yet are lost.

    The file system is asked apart from Spark, so a stopped session is no hindrance; where it can't be, the active session is.
    """
    from pyarrow import fs

    for uri in [_FOLDERS.pop() for _ in range(len(_FOLDERS))]:
        try:
            system, path = fs.FileSystem.from_uri(uri)
            system.delete_dir(path)
        except Exception:
            with contextlib.suppress(Exception):  # nothing is left to ask
                _delete(SparkSession.getActiveSession(), uri)


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers hold small whatever the texts' lengths are.

    These two session settings are only lowered, and stay so, as they count when a result is computed.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(name)
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(name, str(most))


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", held: str | None = None) -> DataFrame:
    """many joined with one, which has a row per key, on keys that are never null; no key's rows go to a single task.

    held names a column of one that has the number of a key's rows in many, if there is one; how is inner then. The
    table that has the numbers is read more than once.
    """
    counts = one.select(*keys, F.col(held).alias("n")) if held else many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return dealt_join(many, one, keys, *hot_keys(counts), how)


def hot_keys(counts: DataFrame) -> tuple[int, list[tuple]]:
    """The bound above which a key is hot, and the hot ones among counts (keys, n) with their n.

    A key is hot if it holds more than 1 / SHARE of an average shuffle partition of all counted rows. So hot keys are
    fewer than SHARE times the partitions, which bounds what is collected about them. As nothing up to MIN_HOT counts
    as hot, small tables have none.
    """
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(MIN_HOT, (total or 0) // (SHARE * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return limit, [tuple(r) for r in counts.filter(F.col("n") > limit).collect()] if (most or 0) > limit else []


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], limit: int, hot: list[tuple], how: str = "inner") -> DataFrame:
    """many joined with one, the rows of a hot key (keys, n) dealt to n / limit places.

    Its row of one is copied to each of them: in all fewer copies than twice the bound on hot keys, and the list of
    hot keys, which is broadcast, is as bounded.
    """
    if not hot:
        return many.join(one, keys, how)
    schema = T.StructType([*[many.schema[k] for k in keys], T.StructField(f"{OWN}salts", T.LongType())])
    salts = F.broadcast(many.sparkSession.createDataFrame([(*k, -(-n // limit)) for *k, n in hot], schema))
    n = F.coalesce(F.col(f"{OWN}salts"), F.lit(1))
    rest = [c for c in many.columns if c not in keys]
    dealt = F.pmod(F.xxhash64(*(rest or keys)), n) if rest else F.floor(F.rand(7) * n).cast("long")
    many = many.join(salts, keys, "left").withColumn(f"{OWN}salt", dealt).drop(f"{OWN}salts")
    one = one.join(salts, keys, "left").withColumn(f"{OWN}salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop(f"{OWN}salts")
    return many.join(one, [*keys, f"{OWN}salt"], how).drop(f"{OWN}salt")


def annotate(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list]], fields: list[T.StructField]) -> DataFrame:
    """df with one more column per field, computed from text_col in Arrow batches.

    make runs once in each task and returns a function from a list of texts (None for null) to one
    sequence per field. All columns of df pass through unchanged, so no join is needed afterwards; only columns with
    a field's own name are replaced, as when an operator is applied to its own output.
    """
    bound_batches(df.sparkSession)
    df = df.drop(*[f.name for f in fields])
    at = df.columns.index(text_col)
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("columns must have distinct names")
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [_arrow(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for part in pieces(batch, at):
                made = call(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=names)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column at holds about limit bytes each; a longer text is alone in its slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def send(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value whose size the caller bounds; calling the result on an executor gives it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def forget(held: dict, most: int) -> None:
    """Drop the older half of a cache that has grown beyond most entries."""
    if len(held) > most:
        for k in list(islice(held, len(held) // 2)):
            del held[k]


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of an id's decimal text modulo n; the training folds are defined by it."""
    return F.pmod(F.crc32(col.cast("string")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents, dealt to as many tasks as run at once where its files split into fewer.

    Passes over texts take far longer than moving them once; where files split enough, nothing is moved.
    """
    docs, most = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= most else docs.repartition(most)
