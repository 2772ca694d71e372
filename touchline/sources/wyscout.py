"""Wyscout event files: a JSON array of a whole competition's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pitch import WYSCOUT_PITCH, on_pitch
from ..functions.times import split_seconds, wyscout_period
from ..functions.validation import require_sound
from .statsbomb import finished, match_column
from .variants import Record, integer, records

PROVIDER = "Wyscout"
# fixed value: the tag of an accurate event
ACCURATE = 1801


def tag_outcome(ids: Column) -> Column:
    """Accurate if any tag says so, else null."""
    return F.when(F.exists(ids, lambda i: i == ACCURATE), "Accurate")


def load_events(spark: SparkSession, path: str, match_id: int) -> DataFrame:
    """The events of one match in array order. Every element must be an object with a matchId; only the match's own are read further. No event of the match is an error."""
    wanted = match_column(match_id)
    rows = records(spark, path, f"{PROVIDER} event")
    own = Record(F.col("v"), "own")
    match = own.required("$.matchId", "bigint")
    rows = own.bound(rows).withColumn("_match", match)
    require_sound(rows.withColumn("_error", own.error()), "_error", PROVIDER + " event at index {}")
    rows = rows.where(F.col("_match") == wanted)
    if rows.isEmpty():
        raise ValueError(f"{PROVIDER} event file '{path}' has no events of match {match_id}")
    v = F.col("v")
    r = Record(v)
    name = r.required("$.matchPeriod", "string")
    period, offset = wyscout_period(name)
    r.complain(name.isNotNull() & period.isNull(), F.concat(F.lit("unknown matchPeriod '"), name, F.lit("'")))
    seconds = r.required("$.eventSec", "double")
    r.complain(F.isnan(seconds) | (seconds < 0) | (seconds == float("inf")), "eventSec is negative or not finite")
    r.complain(~r.is_array("$.positions"), "field 'positions' is no array")
    r.complain(~r.absent("$.positions[2]"), "more than two positions")
    millis, minute, second = split_seconds(seconds, offset)
    player = r.required("$.playerId", "bigint")
    fields = {
        "provider_event_id": r.required("$.id", "bigint").cast("string"),
        "match_id": wanted,
        "period": period,
        "timestamp": millis,
        "minute": minute,
        "second": second,
        "team_id": r.required("$.teamId", "bigint"),
        "player_id": F.nullif(player, F.lit(0).cast("long")),
        "event_type": r.required("$.eventName", "string"),
        "provider": F.lit(PROVIDER),
    }
    tags = F.try_variant_get(v, "$.tags", "array<variant>")
    r.complain(~r.absent("$.tags") & ~r.is_array("$.tags"), "field 'tags' is no array")
    r.complain(F.exists(tags, lambda t: ~F.schema_of_variant(t).like("OBJECT<%")), "a tag is no object")
    r.complain(F.exists(tags, lambda t: integer(t, "$.id").isNull()), "a tag has no id")
    fields["outcome"] = tag_outcome(F.transform(tags, lambda t: integer(t, "$.id")))
    for i, point in enumerate(("start", "end")):
        there = f"$.positions[{i}]"
        r.complain(r.kind(there).isNotNull() & ~r.is_object(there), "a position is no object")
        inside = r.is_object(there)
        x, y = (F.when(inside, r.optional(f"{there}.{axis}", "double")) for axis in "xy")
        r.complain(inside & (x.isNull() | y.isNull()), "a position lacks x or y")
        r.complain(~on_pitch(x, y, *WYSCOUT_PITCH), "a position lies outside the pitch")
        fields |= {f"source_{point}_x": x, f"source_{point}_y": y, f"{point}_x": x, f"{point}_y": y}
    return finished(r.bound(rows), fields, r.error(), PROVIDER + " event at index {}")
