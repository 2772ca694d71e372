"""Event stores: Parquet with the fixed schema. A store is written once; readers prune columns, partitions and row groups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.validation import event_error, require_sound
from ..schema import EVENT_SCHEMA_ORD


def save_events(events: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Refuses to replace a store. Give partition columns (provider, match_id) for many matches; a store of one match needs none."""
    writer = events.select(*EVENT_SCHEMA_ORD.names).write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_events(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A store's events. The files' own schema must be the fixed one; with check, one job holds every event against the rules."""
    found = spark.read.parquet(path)
    have = {f.name: f.dataType for f in found.schema.fields}
    for f in EVENT_SCHEMA_ORD.fields:
        if have.get(f.name) != f.dataType and f.name not in ("match_id", "provider"):
            raise ValueError(f"Event store '{path}': column '{f.name}' is not {f.dataType.simpleString()}")
    if extra := set(have) - set(EVENT_SCHEMA_ORD.names):
        raise ValueError(f"Event store '{path}': unknown columns {sorted(extra)}")
    events = spark.read.schema(EVENT_SCHEMA_ORD).parquet(path).select(*EVENT_SCHEMA_ORD.names)
    if check:
        require_sound(events.withColumn("_error", event_error()), "_error", f"Event store '{path}' row {{}}")
    return events


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
