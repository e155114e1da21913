"""What the training-data operators share: shared-folder tables and text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a worker's function sees at a time.
SLICE = 1024
#: Greatest input that is dealt to all cores by a shuffle.
SPREAD = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that
    is unset a temporary one, which is then set, if driver and executors are one process.
    On a cluster that would be a folder that executors do not see: an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='vellum-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}/{label}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stash(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts lineage: writes ``df`` once as Parquet (with the writer's ``options``) in the
    shared folder and reads it back.

    Unlike a local checkpoint it outlives executors, and unlike ``checkpoint()`` it is
    computed once, columnar, and later scans read only the columns that they need."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a ``stash`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small input to all cores: one of at most SPREAD bytes whose files
    are so few that a scan would leave three quarters of them idle. A larger one is left
    where it is read."""
    session = df.sparkSession._jsparkSession
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.repartition(cores) if size < min(SPREAD, cores * session.sessionState().conf().filesMaxPartitionBytes() // 4) else df


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no further column can clash with an output."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a per-task set-up: ``make()`` runs once in the task and
    returns the function for each batch, which has at most SLICE rows, so that what a
    worker makes at a time stays small."""

    def run(batches):
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield from step(batch.slice(at, SLICE))

    if isinstance(schema, T.StructType):  # whatever the input promised, outputs may be null
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Python workers get batches of at most ``rows`` rows from what runs inside; for
    operators whose workers hold large tables besides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | None]:
    """The texts one after another, so that one Python string lives at a time."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(mod), F.lit(0))
