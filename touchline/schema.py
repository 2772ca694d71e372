"""The fixed event schema: 22 typed columns, their logical types and the rules that every event keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Rank of an event in its source; hidden from users, and the order of every result.
ORD = "_ord"

IDENTIFIER, INTEGER, TIMESTAMP, NUMBER, TEXT = "identifier", "integer", "timestamp", "number", "text"

_SPARK = {IDENTIFIER: T.LongType(), INTEGER: T.IntegerType(), TIMESTAMP: T.LongType(), NUMBER: T.DoubleType(), TEXT: T.StringType()}


@dataclass(frozen=True)
class EventColumn:
    id: int
    name: str
    kind: str
    nullable: bool

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK[self.kind]

    @property
    def numeric(self) -> bool:
        """Whether sums and averages are defined. Identifiers and times are numbers, but not amounts."""
        return self.kind in (INTEGER, NUMBER)


# fixed values: names, order (the id is the rank), types and nullability of the columns
EVENT_COLUMNS: tuple[EventColumn, ...] = tuple(
    EventColumn(i, name, kind, nullable)
    for i, (name, kind, nullable) in enumerate(
        (
            ("provider_event_id", TEXT, False),
            ("match_id", IDENTIFIER, False),
            ("period", INTEGER, False),
            ("timestamp", TIMESTAMP, False),
            ("minute", INTEGER, False),
            ("second", INTEGER, False),
            ("possession_id", IDENTIFIER, True),
            ("team_id", IDENTIFIER, True),
            ("team_name", TEXT, True),
            ("player_id", IDENTIFIER, True),
            ("player_name", TEXT, True),
            ("event_type", TEXT, False),
            ("outcome", TEXT, True),
            ("start_x", NUMBER, True),
            ("start_y", NUMBER, True),
            ("end_x", NUMBER, True),
            ("end_y", NUMBER, True),
            ("provider", TEXT, False),
            ("source_start_x", NUMBER, True),
            ("source_start_y", NUMBER, True),
            ("source_end_x", NUMBER, True),
            ("source_end_y", NUMBER, True),
        )
    )
)

_BY_NAME = {c.name: c for c in EVENT_COLUMNS}

EVENT_SCHEMA = T.StructType(
    [T.StructField(c.name, c.spark_type, True, {"column_id": c.id, "logical_type": c.kind, **({"unit": "ms"} if c.kind == TIMESTAMP else {})}) for c in EVENT_COLUMNS]
)
EVENT_SCHEMA_ORD = T.StructType([*EVENT_SCHEMA.fields, T.StructField(ORD, T.LongType(), True)])


def event_column(name: str) -> EventColumn:
    """Lookup by exact name; Spark's own resolution would ignore case."""
    try:
        return _BY_NAME[name]
    except KeyError:
        raise ValueError(f"Unknown event column '{name}'") from None
