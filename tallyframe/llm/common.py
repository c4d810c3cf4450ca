"""Shared helpers of the training-data operators.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; a private folder is set only where none is named
(tests, local runs).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch, where the session leaves Spark's own number: texts of 100 KB make a batch of 100 MB then, not 1 GB.
BATCH_ROWS, SPARK_ROWS = 1000, "10000"


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, SPARK_ROWS) == SPARK_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    found = found or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


class Scratch:
    """Written intermediate tables: lineage ends at each, and a lost executor costs nothing.

    ``keep`` writes and rereads a table; ``drop`` deletes one that no pending plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/tallyframe-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size, with a middling one where it has none; reads nothing."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 60 else 1 << 32


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _settle() -> None:
    """Large arrays go back to the system when they are freed: workers live on, beside the executor's heap."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which grows by itself otherwise
    except (OSError, AttributeError):
        pass


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers keep no freed memory from one task to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settle()
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch; nothing is kept between batches except what ``fn`` itself memoises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return map_arrow(df, run, schema)
