"""Change detection on a stream of scanned files: an addition to the batch form, with the same statuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import inventory


def watch(spark: SparkSession, incoming: str, snapshot: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Take the Parquet files in ``incoming`` (repo_id, path, size, mtime, content) that weren't taken before, then stop.

    Each batch gets metadata and a status against ``snapshot``, goes to ``sink`` and is added to the snapshot as a folder of
    its own, so that a batch that is run again writes the same again. The latest state of a path is that of the last batch.
    """
    schema = spark.read.parquet(incoming).schema

    def one(batch: DataFrame, at: int) -> None:
        before = latest(spark, snapshot, at)
        got = inventory.change_status(inventory.metadata(batch), before).persist()
        try:
            sink(got, at)
            got.select("repo_id", "path", "hash", "todo_count").write.mode("overwrite").parquet(f"{snapshot}/batch={at}")
        finally:
            got.unpersist()

    return spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, snapshot: str, before: int) -> DataFrame | None:
    """repo_id, path, hash, todo_count of each path's last batch under ``before``; None if there is none."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    try:
        rows = spark.read.parquet(snapshot).filter(F.col("batch") < before)
    except AnalysisException:
        return None
    last = rows.groupBy("repo_id", "path").agg(F.max_by(F.struct("hash", "todo_count"), "batch").alias("x"))
    return last.select("repo_id", "path", "x.hash", "x.todo_count")
