"""Keeps the folded state of a planner-action log up to date from a stream of new actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators.actions import latest_by
from ..sources.writers import write_table


def fold_stream(
    log: DataFrame, state_path: str, keys: Sequence[str], ts: str = "updated_at", seq: str = "seq",
    created: str = "created_at",
) -> DataStreamWriter:
    """Writer that folds every micro-batch into the state under ``state_path``.

    State and batch are folded by (time, sequence), so the result is that of ``latest_by`` over the whole log however it was
    cut into batches, late rows included. Each batch writes the next version ``v=<batch>`` from the one before it, so a batch
    that is run again after a failure reads the same input version and gives the same result; older versions are removed.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = spark.read.schema(batch.schema).parquet(version_path(state_path, batch_id - 1)).unionByName(batch)
        write_table(latest_by(rows, keys, ts, seq, created).select(*batch.columns), version_path(state_path, batch_id))
        remove(spark, version_path(state_path, batch_id - 2))

    return log.writeStream.foreachBatch(fold).outputMode("update")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, in whatever store holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def version_path(state_path: str, version: int) -> str:
    return f"{state_path}/v={version}"
