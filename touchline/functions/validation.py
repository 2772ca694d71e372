"""The rules of an event, as one expression that names the first broken one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ORD
from .pitch import finite
from .text import is_blank


class InvalidEvents(ValueError):
    """A source holds an event that breaks a rule; nothing of it is loaded."""


def event_error(get=F.col) -> Column:
    """Null for a sound event, else a text that names the field; rules are tried in the order of the schema's documentation: numbers, texts, coordinates."""
    bad: list[tuple[Column, str]] = []
    blank = lambda c: is_blank(get(c))
    missing = lambda c: get(c).isNull()
    bad.append((missing("provider_event_id") | blank("provider_event_id"), "provider_event_id must not be blank"))
    for c in ("match_id", "period"):
        bad.append((missing(c) | (get(c) <= 0), f"{c} must be positive"))
    for c in ("timestamp", "minute"):
        bad.append((missing(c) | (get(c) < 0), f"{c} must not be negative"))
    bad.append((missing("second") | ~get("second").between(0, 59), "second must be between 0 and 59"))
    for c in ("possession_id", "team_id", "player_id"):
        bad.append((get(c) <= 0, f"{c} must be positive"))
    for c in ("team_name", "player_name"):
        bad.append((blank(c), f"{c} must not be blank"))
    bad.append((missing("event_type") | blank("event_type"), "event_type must not be blank"))
    bad.append((blank("outcome"), "outcome must not be blank"))
    bad.append((missing("provider") | blank("provider"), "provider must not be blank"))
    for c in ("start", "end"):
        x, y = get(f"{c}_x"), get(f"{c}_y")
        bad.append((x.isNull() != y.isNull(), f"{c} coordinates must be present together"))
        for axis, v in (("x", x), ("y", y)):
            bad.append((~finite(v) | ~v.between(0.0, 100.0), f"{c}_{axis} must be between 0 and 100"))
    for c in ("source_start", "source_end"):
        x, y = get(f"{c}_x"), get(f"{c}_y")
        bad.append((x.isNull() != y.isNull(), f"{c} coordinates must be present together"))
        for axis, v in (("x", x), ("y", y)):
            bad.append((~finite(v), f"{c}_{axis} must be finite"))
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in bad], F.lit(None).cast("string"))


def require_sound(df: DataFrame, error: str, where: str) -> None:
    """Raises for the first row (by ORD) whose error column is set. It runs a job: a lazily raised error would vanish with the pruned column."""
    first = df.where(F.col(error).isNotNull()).agg(F.min_by(error, ORD).alias("text"), F.min(ORD).alias("at")).first()
    if first["text"] is not None:
        raise InvalidEvents(f"{where.format(first['at'])}: {first['text']}")
