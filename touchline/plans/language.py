"""The textual forms of queries: COLUMN,COLUMN; COLUMN=VALUE; FUNCTION(COLUMN)."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from ..schema import IDENTIFIER, INTEGER, NUMBER, TEXT, TIMESTAMP, event_column
from .query import Aggregate, AggregationQuery, Equals, EventQuery, Millis


def column_list(text: str) -> list[str]:
    """Names between commas, as they stand; none may be empty."""
    names = text.split(",")
    if not all(names):
        raise ValueError("Column lists must not contain empty names")
    for n in names:
        event_column(n)
    return names


def whole_number(text: str, bits: int = 64) -> int:
    if not re.fullmatch(r"-?[0-9]+", text, re.ASCII) or not -(2 ** (bits - 1)) <= int(text) < 2 ** (bits - 1):
        raise ValueError(f"Invalid integer '{text}'")
    return int(text)


def real_number(text: str) -> float:
    if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text, re.ASCII) or not math.isfinite(float(text)):
        raise ValueError(f"Invalid number '{text}'")
    return float(text)


def equality(text: str) -> Equals:
    """Split at the first =; an empty text value is a value."""
    name, sign, value = text.partition("=")
    if not sign or not name:
        raise ValueError(f"Filter '{text}' must have the form COLUMN=VALUE")
    read = {IDENTIFIER: whole_number, INTEGER: lambda t: whole_number(t, 32), TIMESTAMP: lambda t: Millis(whole_number(t)), NUMBER: real_number, TEXT: str}
    return Equals(name, read[event_column(name).kind](value))


def aggregate_call(text: str) -> Aggregate:
    m = re.fullmatch(r"([a-z]+)\(([^()]+)\)", text)
    if not m:
        raise ValueError(f"Aggregate '{text}' must have the form FUNCTION(COLUMN)")
    if m[2] == "*":
        if m[1] != "count":
            raise ValueError(f"'*' is only allowed in count(*), not in '{text}'")
        return Aggregate("count")
    return Aggregate(m[1], m[2])


def event_query(project: str, filters: Sequence[str] = ()) -> EventQuery:
    return EventQuery(column_list(project), [equality(f) for f in filters])


def aggregation_query(aggregates: Sequence[str], group_by: str | None = None, filters: Sequence[str] = ()) -> AggregationQuery:
    return AggregationQuery([aggregate_call(a) for a in aggregates], column_list(group_by) if group_by is not None else [], [equality(f) for f in filters])
