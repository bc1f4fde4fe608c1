"""Change logs as streams: current state from any order of arrival.

Newest write wins needs no watermark: the sequence number decides, and deletions stay
in the state so that a late older write can't bring a key back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators.fold import newest
from tidefold.sources.runs import RunStore


def state(stream: DataFrame) -> DataFrame:
    """The newest record of every key as a streaming aggregate; for output modes update and complete."""
    return newest(stream.select("k", "op", "v", "seq"), "k")


def into_runs(stream: DataFrame, store: RunStore, checkpoint: str, compact: bool = True):
    """Start a query that folds each micro-batch into a run of the store and compacts when there are too many.

    Batches may come in any order of their records: the store orders by sequence number
    and keeps deletions. A batch that is delivered again after a failure is recognised
    by its number and the checkpoint folder, so several streams may feed one store, and a stream that
    starts anew with another checkpoint is read again, which changes nothing.
    """
    def take(batch: DataFrame, number: int) -> None:
        store.append(batch, number, checkpoint)
        if compact:
            store.compact()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, change_log, folder: str, files_per_batch: int = 1) -> DataFrame:
    """(k, v, seq) of a log read as a stream of files, by runs in `folder`."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a folder or a single file, a plain path only a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    store = RunStore(spark, f"{folder}/store")
    into_runs(change_log(stream), store, f"{folder}/checkpoint").awaitTermination()
    return store.current()
