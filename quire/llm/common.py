"""Tables, row ids and written intermediate results shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import scratch_path, ship_package

#: Bytes of text that one Python step takes at a time; a longer single text is a step of its own.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers."""
    ship_package(spark)
    return spark


#: Of intermediate tables: texts take less disk, and its buffers lie on the heap (snappy's direct ones stay with the pool).
CODEC = "zstd"
#: Rows in an Arrow batch, at most, while an intermediate table is written: texts are long.
BATCH_ROWS = 1024


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Plans that are run inside hand rows to Python in batches of ``rows`` at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what lies
    before, and ids made by ``monotonically_increasing_id`` are fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{what}-{uuid.uuid4().hex}")
    with small_batches(spark):
        df.write.option("compression", CODEC).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove what ``written`` or ``bucketed`` made, after the last job that reads it (what came of it is written by then)."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if getattr(df, "_table", None):
            spark.sql(f"DROP TABLE {df._table}")


def bucketed(df: DataFrame, what: str, by: str, buckets: int, rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` written to the shared folder as a table bucketed by column ``by``, and read back.

    Rows don't move: a task writes a file for each bucket that its rows fall into, so ``by`` should have few values a
    task. Joins on ``by`` (see ``co_located``) then shuffle their other side alone.
    """
    spark = df.sparkSession
    name = f"llm_{what}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    with small_batches(spark, rows):
        df.write.format("parquet").option("compression", CODEC).bucketBy(buckets, by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._folder, out._table = path, name
    return out


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Plans that are run inside let a join on several columns use tables that are bucketed by one of them."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bits of a row id that number the rows of a chunk; a task's rows form a few chunks.
ROW_BITS = 14


def with_chunk(df: DataFrame) -> DataFrame:
    """``chunk``, by which ``text_table`` is bucketed, from ``uid``."""
    return df.withColumn("chunk", F.shiftright("uid", ROW_BITS))


def text_table(df: DataFrame) -> DataFrame:
    """``df`` with a row id ``uid``, bucketed by ``chunk``: what is joined by chunk and uid comes to the texts."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(with_chunk(with_uid(df)), "texts", "chunk", buckets)


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """A row id (use it only on a frame that is then ``written``), so repeated or null keys never merge rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


def boxed(df: DataFrame) -> list[Column]:
    """``_in``, a struct of all columns but ``text``, and ``text``: no input column can clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != "text"]
    return [F.struct(*rest).alias("_in"), F.col("text").cast("string").alias("text")]


def unboxed(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.select(*(F.col("text") if c == "text" else F.col("_in").getField(c).alias(c) for c in columns), *more)


def row_keys(df: DataFrame, columns: list) -> DataFrame:
    """``columns`` plus ``_file`` and ``_row``, which name a row alike in every scan of the same files.

    They come from the scan's hidden metadata (64-bit hash of the file's path, the row's place in it); a frame that
    isn't a plain scan is written to the shared folder first.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = written(df, "rows")
    return df.select(*columns, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def give_back() -> None:
    """Hand freed memory back to the system, so that a reused worker doesn't grow from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices holding about ``size`` bytes of ``column``; never inside a row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        start = total = 0
        for i, n in enumerate(sizes.to_pylist()):
            if i > start and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)
        give_back()


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
