"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning is what copes with hot join keys and with partition counts nobody can guess.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A join on two keys shuffles on both of them; on one, all slices of a hot key would meet again.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    # Lists per key are built by object aggregates; past this many keys in a task they start to sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
    # The JVM does not compile methods over 8000 bytes of code. A stage with many text expressions that would
    # become one such method runs operator by operator instead, where the expressions are split up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording a call site for every column expression doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "needmap", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that the driver and all executors see, below the one that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local master takes one below its warehouse; on a cluster, where that could be a folder of one
    machine, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.rstrip('/')}/needmap-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.append(folder)
    return f"{folder}/{name}"


_folders: list[str] = []


@atexit.register
def remove_folders() -> None:
    """Removes the shared folders of this process when it ends."""
    jvm = SparkContext._jvm
    with contextlib.suppress(Exception):
        while jvm is not None and _folders:
            path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame, stored as Parquet in the shared folder and read back: for what several actions read, or a join should know the size of.

    What is read back survives lost executors and has a measured size; a checkpoint would keep the size estimate of its plan.
    """
    spark = df.sparkSession
    path = shared_folder(spark, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
