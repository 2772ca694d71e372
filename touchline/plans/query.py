"""Typed event queries: equality filters, projections and grouped aggregates, built as one DataFrame plan."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IDENTIFIER, INTEGER, NUMBER, ORD, TEXT, TIMESTAMP, EventColumn, event_column


class Millis(int):
    """A literal of a time column."""


@dataclass(frozen=True)
class Equals:
    """column = value. The literal has the column's own type: nothing is converted."""

    column: str
    value: object

    def __post_init__(self) -> None:
        kind, v = event_column(self.column).kind, self.value
        fits = {
            IDENTIFIER: type(v) is int and -(2**63) <= v < 2**63,
            INTEGER: type(v) is int and -(2**31) <= v < 2**31,
            TIMESTAMP: type(v) is Millis,
            NUMBER: type(v) is float and math.isfinite(v),
            TEXT: type(v) is str,
        }[kind]
        if not fits:
            raise ValueError(f"Filter value for '{self.column}' must be of type {kind}")

    def condition(self) -> Column:
        c = event_column(self.column)
        value = int(self.value) if isinstance(self.value, Millis) else self.value
        return F.col(c.name) == F.lit(value).cast(c.spark_type)


@dataclass(frozen=True)
class EventQuery:
    projection: Sequence[str]
    filters: Sequence[Equals] = ()

    def __post_init__(self) -> None:
        if not self.projection:
            raise ValueError("A query needs at least one projected column")
        distinct("projected column", self.projection)
        for c in self.projection:
            event_column(c)


@dataclass(frozen=True)
class Aggregate:
    """count without a column counts rows; with one, its non-null values."""

    function: str
    column: str | None = None

    def __post_init__(self) -> None:
        if self.function not in ("count", "sum", "avg", "min", "max"):
            raise ValueError(f"Unknown aggregate function '{self.function}'")
        if self.column is None:
            if self.function != "count":
                raise ValueError(f"{self.function} needs a column")
        elif not event_column(self.column).numeric and self.function in ("sum", "avg"):
            raise ValueError(f"{self.function} needs a numeric column, not '{self.column}'")

    @property
    def name(self) -> str:
        return f"{self.function}({self.column or '*'})"

    def expression(self) -> Column:
        if self.column is None:
            return F.count(F.lit(1)).alias(self.name)
        return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.function](self.column).alias(self.name)


@dataclass(frozen=True)
class AggregationQuery:
    aggregates: Sequence[Aggregate]
    group_by: Sequence[str] = ()
    filters: Sequence[Equals] = field(default=())

    def __post_init__(self) -> None:
        if not self.aggregates:
            raise ValueError("An aggregation needs at least one aggregate")
        distinct("aggregate", [a.name for a in self.aggregates])
        distinct("group column", self.group_by)
        for c in self.group_by:
            event_column(c)

    @property
    def columns(self) -> list[str]:
        return [*self.group_by, *(a.name for a in self.aggregates)]


def distinct(what: str, names: Sequence[str]) -> None:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise ValueError(f"Duplicate {what} '{n}'")
        seen.add(n)


def matching(events: DataFrame, filters: Sequence[Equals]) -> DataFrame:
    """Rows that meet all filters; a null never does."""
    for f in filters:
        events = events.where(f.condition())
    return events


def project(events: DataFrame, query: EventQuery) -> DataFrame:
    """The chosen columns of matching events in source order. The order column is sorted by, never returned."""
    return matching(events, query.filters).select(*query.projection, ORD).orderBy(ORD).select(*query.projection)


def aggregate(events: DataFrame, query: AggregationQuery) -> DataFrame:
    """One row without grouping, even of nothing; else one a group, nulls forming a group too, by first appearance."""
    rows = matching(events, query.filters)
    made = [a.expression() for a in query.aggregates]
    if not query.group_by:
        return rows.agg(*made)
    return rows.groupBy(*query.group_by).agg(*made, F.min(ORD).alias("_first")).orderBy("_first").drop("_first")


def execute(events: DataFrame, query: EventQuery | AggregationQuery) -> DataFrame:
    return project(events, query) if isinstance(query, EventQuery) else aggregate(events, query)


def counters(events: DataFrame) -> DataFrame:
    """Rows, and how many have a player, a start and an end location."""
    some = lambda c: F.count_if(c)
    return events.agg(
        F.count(F.lit(1)).alias("rows"),
        some(F.col("player_id").isNotNull() | F.col("player_name").isNotNull()).alias("player_data"),
        some(F.col("start_x").isNotNull()).alias("start_locations"),
        some(F.col("end_x").isNotNull()).alias("end_locations"),
    )


def rebuilt(events: DataFrame) -> DataFrame:
    """Rows in nested form: time and four points, a point being null unless both its coordinates are present."""
    point = lambda c: F.when(F.col(f"{c}_x").isNotNull() & F.col(f"{c}_y").isNotNull(), F.struct(F.col(f"{c}_x").alias("x"), F.col(f"{c}_y").alias("y"))).alias(f"{c}_location")
    flat = "provider_event_id match_id period possession_id team_id team_name player_id player_name event_type outcome provider".split()
    return events.select(*flat, F.struct("timestamp", "minute", "second").alias("time"), *map(point, ("start", "end", "source_start", "source_end")), ORD)


