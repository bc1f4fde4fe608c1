"""Folders that driver and executors share, and tables written there.

Everything that must outlive a stage (intermediate tables, cut lineage) goes to
the folder named by ``spark.checkpoint.dir``. Only where that setting is absent
and all run on one machine, as in tests, a temporary folder is made.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.sources.files import base_folder

_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared folder, as a URI that Spark can write to."""
    return f"{base_folder(spark)}/tidefold-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Bound what goes between Spark and Python at a time: batches of whole texts are long with the usual 10,000 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on from one stage to the next."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a while; then it is what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


ROW_GROUP = str(32 << 20)  # writers hold a row group each


def _no_shuffles_left(spark: SparkSession):
    """What is written needs no shuffle files any more: they go when the write has ended, not when the driver next collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    with _no_shuffles_left(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """As written(), for large values: compressed by zstd at a high level, in pages long enough that rows like each other help."""
    path = new_path(df.sparkSession, name)
    with _no_shuffles_left(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "12").option("parquet.page.size", str(8 << 20)).option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As written(), but bucketed by key, so that later joins and groups on it need no shuffle of this side."""
    table = f"tidefold_{name}_{uuid.uuid4().hex}"
    path = new_path(df.sparkSession, name)
    with _no_shuffles_left(df.sparkSession):
        df.write.format("parquet").bucketBy(buckets, key).option("parquet.block.size", ROW_GROUP).option("path", path).saveAsTable(table)
    _tables.append(table)
    return df.sparkSession.table(table)


def cleanup(spark: SparkSession) -> None:
    """Drop the intermediate tables of this application; results computed from them must have been written before."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_bytes(df: DataFrame) -> int:
    """How many bytes the sources of df have, as far as Spark knows; nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # a source of unknown size counts as the largest number there is


def apart(column: str):
    """The same number, but not the column itself: a join on it deals both sides anew, which lets Spark split hot keys."""
    return F.col(column).bitwiseXOR(F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
