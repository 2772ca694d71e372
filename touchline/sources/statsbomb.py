"""StatsBomb event files: a JSON array of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pitch import STATSBOMB_PITCH, canonical, on_pitch
from ..functions.times import clock_millis
from ..functions.validation import event_error, require_sound
from ..schema import EVENT_COLUMNS, ORD
from .variants import Record, records

PROVIDER = "StatsBomb"
# fixed values: where outcomes and end locations stand, in order of preference
OUTCOMES = ("pass", "shot", "duel", "dribble", "goalkeeper")
ENDS = ("pass", "carry")


def match_column(match_id: int | Column) -> Column:
    if isinstance(match_id, int):
        if match_id <= 0:
            raise ValueError("match_id must be positive")
        return F.lit(match_id).cast("long")
    return match_id.cast("long")


def finished(rows: DataFrame, fields: dict[str, Column], error: Column, where: str) -> DataFrame:
    """Events of the fixed schema with ORD, after one job that checks them all."""
    typed = {c.name: fields.get(c.name, F.lit(None)).cast(c.spark_type).alias(c.name) for c in EVENT_COLUMNS}
    out = rows.select(*typed.values(), ORD, error.alias("_source_error"))
    out = out.withColumn("_error", F.coalesce("_source_error", event_error()))
    require_sound(out, "_error", where)
    return out.select(*typed, ORD)


def load_events(spark: SparkSession, path: str, match_id: int | Column) -> DataFrame:
    """All events in array order; the first bad one fails the load. With a path of many files, match_id may be an expression over `file`."""
    rows = records(spark, path, f"{PROVIDER} event")
    r = Record(F.col("v"))
    clock = r.required("$.timestamp", "string")
    fields = {"provider_event_id": r.required("$.id", "string"), "match_id": match_column(match_id), "period": r.required("$.period", "int")}
    fields["timestamp"] = clock_millis(clock)
    r.complain(clock.isNotNull() & fields["timestamp"].isNull(), F.concat(F.lit("no clock time: '"), clock, F.lit("'")))
    fields |= {"minute": r.required("$.minute", "int"), "second": r.required("$.second", "int"), "possession_id": r.optional("$.possession", "bigint")}
    for who in ("team", "player"):
        r.object(f"$.{who}")
        fields |= {f"{who}_id": r.optional(f"$.{who}.id", "bigint"), f"{who}_name": r.optional(f"$.{who}.name", "string")}
    r.object("$.type", required=True)
    fields["event_type"] = r.required("$.type.name", "string")
    for detail in dict.fromkeys((*OUTCOMES, *ENDS)):
        r.object(f"$.{detail}")
    for detail in OUTCOMES:
        r.object(f"$.{detail}.outcome")
    fields["outcome"] = F.coalesce(*[r.optional(f"$.{d}.outcome.name", "string") for d in OUTCOMES])
    points = {"start": r.point("$.location")}
    ends = [r.point(f"$.{d}.end_location") for d in ENDS]
    points["end"] = tuple(F.coalesce(*[e[i] for e in ends]) for i in (0, 1))
    for name, (x, y) in points.items():
        field = "location" if name == "start" else "end_location"
        r.complain(~on_pitch(x, y, *STATSBOMB_PITCH), f"'{field}' lies outside the pitch")
        nx, ny = canonical(x, y, *STATSBOMB_PITCH)
        fields |= {f"source_{name}_x": x, f"source_{name}_y": y, f"{name}_x": nx, f"{name}_y": ny}
    fields["provider"] = F.lit(PROVIDER)
    return finished(r.bound(rows), fields, r.error(), PROVIDER + " event at index {}")
