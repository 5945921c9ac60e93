"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are written for. A join on (security_id, date) may reuse
# a partitioning on security_id, so a panel is exchanged once per stage. Windows and patches
# widen rows after their exchange, so small exchanges are not merged below the core count.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}

_local_folders: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, else the context's checkpoint dir.

    Only a local master may fall back to a temporary folder of this machine, which is deleted
    when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    key = context.applicationId
    if key not in _local_folders:
        _local_folders[key] = folder = tempfile.mkdtemp(prefix="factorloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_folders[key]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write a stage table as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors, freezes values that later plans must agree on,
    and gives Catalyst a true size to choose broadcast or shuffle joins by.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
