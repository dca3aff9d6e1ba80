"""The write stream: micro-batches of operations, stateful sizes, the write service."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

OPS = "seq long, ino long, offset long, length long"


def read_ops(spark: SparkSession, folder: str, files_per_batch: int = 4) -> DataFrame:
    """Operations appended as Parquet files; a micro-batch takes a few files (a byte limit's counterpart)."""
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def batcher(ops: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> DataStreamWriter:
    """Applies each micro-batch with its id, which grows by one and repeats after a failure, so apply must be idempotent."""
    w = ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)


def drain(writer: DataStreamWriter) -> None:
    """Runs until all that has arrived is applied; the first error of a batch is raised here."""
    q = writer.start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def versions(ops: DataFrame) -> DataFrame:
    """(ino, version, size) updates: operations applied to each inode and its size so far, kept as state for each key."""

    def update(key, batches, state):
        version, size = state.get if state.exists else (0, 0)
        for pdf in batches:
            version, size = version + len(pdf), max(size, int((pdf["offset"] + pdf["length"]).max()))
        state.update((version, size))
        yield pd.DataFrame({"ino": [key[0]], "version": [version], "size": [size]})

    return ops.groupBy("ino").applyInPandasWithState(update, "ino long, version long, size long", "version long, size long", "update", "NoTimeout")


def totals(ops: DataFrame) -> DataFrame:
    """(ino, ops, size) of all operations so far, as a streaming aggregate."""
    return ops.groupBy("ino").agg(F.count("*").alias("ops"), F.max(F.col("offset") + F.col("length")).alias("size"))


class WriteService:
    """Operations put into a folder as files, and a stream that applies them: the queue is the folder, so it outlives both.

    ``apply`` gets each micro-batch with its id and must be idempotent.
    """

    def __init__(self, spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None], schema: str = OPS, files_per_batch: int = 4):
        self.spark, self.folder, self.checkpoint, self.apply, self.schema, self.files = spark, folder, checkpoint, apply, schema, files_per_batch
        self.closed, self.query = False, None
        spark.createDataFrame([], schema).write.mode("append").parquet(folder)  # a stream needs the folder

    def _stream(self, interval: str | None = None) -> DataStreamWriter:
        ops = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.folder)
        return batcher(ops, self.apply, self.checkpoint, interval)

    def enqueue(self, ops: DataFrame) -> None:
        """Adds operations; they are durable on return and applied later."""
        if self.closed:
            raise RuntimeError("the write service is closed")
        ops.write.mode("append").parquet(self.folder)

    def enqueue_and_wait(self, ops: DataFrame) -> None:
        self.enqueue(ops)
        self.drain()

    def drain(self) -> None:
        """Returns when all that has been put in is applied; the first error of a batch is raised here."""
        if self.query is not None and self.query.isActive:
            self.query.processAllAvailable()
        else:
            drain(self._stream())

    def start(self, interval: str) -> None:
        """Applies in the background, every ``interval`` (the periodic sync)."""
        self.query = self._stream(interval).start()

    def shutdown(self) -> None:
        """Refuses new operations, applies the rest and ends; an error of the last batches is raised."""
        self.closed = True
        try:
            self.drain()
        finally:
            if self.query is not None:
                self.query.stop()
