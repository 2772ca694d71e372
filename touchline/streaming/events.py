"""An extension: the stateless parts of the engine over streams of events.

Filters, projections, validation and identity lookups keep no state, so the functions of the batch engine serve streams as
they are; order is the reader's, as a stream has no end to sort at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validation import event_error
from ..operators.identity import resolve_events
from ..plans.query import Equals, EventQuery, matching
from ..schema import EVENT_SCHEMA_ORD


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA_ORD).parquet(path)


def sound_and_broken(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that keep the rules, and those that don't, with the first rule that each breaks."""
    checked = events.withColumn("error", event_error())
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def select_events(events: DataFrame, query: EventQuery) -> DataFrame:
    return matching(events, query.filters).select(*query.projection)


def filter_events(events: DataFrame, filters: Sequence[Equals]) -> DataFrame:
    return matching(events, filters)


def resolved(events: DataFrame, match_mappings: DataFrame, team_mappings: DataFrame, player_mappings: DataFrame) -> DataFrame:
    """A stream of events joined with a catalog that is read once per micro-batch."""
    return resolve_events(events, match_mappings, team_mappings, player_mappings)
