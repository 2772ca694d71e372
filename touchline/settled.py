"""Tables in the folder that the driver and all executors share: lineage ends there, and a lost executor costs no more than one stage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_LOCAL = re.compile(r"local(\[.*\])?")
#: Folders of this process's applications, deleted when it ends.
_OWN: dict[str, SparkSession] = {}


def _base(spark: SparkSession) -> str:
    """The folder that the session names. On one machine, where none is named, a temporary one; on a cluster that would hide tables from executors, so it is an error."""
    context = spark.sparkContext
    base = spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()
    if base:
        return base
    if not _LOCAL.fullmatch(context.master):
        raise RuntimeError(f"Set {SETTING} to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="touchline-")
    atexit.register(shutil.rmtree, base[len("file://") :], True)
    spark.conf.set(SETTING, base)
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path, under one of this application."""
    own = f"{_base(spark).rstrip('/')}/touchline-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN[own] = spark
        atexit.register(_delete, own)
    return f"{own}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _delete(own: str) -> None:
    try:
        delete(_OWN.pop(own), own)
    except Exception:  # noqa: BLE001 - the application is gone, and its file system may be, too
        pass


#: Whether Spark deletes what a query shuffled as soon as it ends, and not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, path: str | None = None, clean: bool = False) -> DataFrame:
    """Write a frame as a shared table and read it again. With `clean`, what was shuffled for it is deleted at once."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, str(clean or before == "true").lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Add each row's place from 0, dense, in the frame's own order.

    The rows are written once together with their partition and their place in it, so that what counts the partitions and
    what is counted are the same rows, however partitions come about. Only one row a partition is summed up in one task.
    """
    held = settle(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_low")).alias("_shift"))
    return held.join(F.broadcast(starts), "_part").select(*ordered.columns, (F.col("_at") + F.col("_shift")).alias(name))
