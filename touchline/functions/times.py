"""Match clocks and kickoffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Wyscout's periods, with the minute at which each starts
WYSCOUT_PERIODS = {"1H": (1, 0), "2H": (2, 45), "E1": (3, 90), "E2": (4, 105), "P": (5, 120)}

_CLOCK = r"\A\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+(?:\.\d*)?|\.\d+)\s*\z"
_DATE = r"\A(\d{4})-(\d{1,2})-(\d{1,2})\z"
_TIME = r"\A(\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d*)?)\z"


def round_millis(seconds: Column) -> Column:
    return F.floor(seconds * F.lit(1000.0) + F.lit(0.5)).cast("long")


def clock_millis(text: Column) -> Column:
    """Milliseconds of hours:minutes:seconds, hours unbounded; null if the text is no such clock."""
    hours, minutes = (F.regexp_extract(text, _CLOCK, i).try_cast("long") for i in (1, 2))
    seconds = F.regexp_extract(text, _CLOCK, 3).try_cast("double")
    valid = text.rlike(_CLOCK) & (minutes < 60) & (seconds < 60.0)
    return F.when(valid, round_millis((hours * 3600 + minutes * 60).cast("double") + seconds))


def split_seconds(seconds: Column, minute_offset: Column | None = None) -> tuple[Column, Column, Column]:
    """Milliseconds, minute (from the offset on) and second of a clock in seconds."""
    whole = F.floor(seconds).cast("long")
    minute = (whole / 60).cast("int") if minute_offset is None else (F.floor(whole / 60).cast("int") + minute_offset)
    return round_millis(seconds), F.floor(whole / 60).cast("int") if minute_offset is None else minute, (whole % 60).cast("int")


def wyscout_period(text: Column) -> tuple[Column, Column]:
    """Number and first minute of a period; null if it isn't known."""
    number = offset = F.lit(None).cast("int")
    for name, (n, start) in WYSCOUT_PERIODS.items():
        number, offset = F.when(text == name, n).otherwise(number), F.when(text == name, start).otherwise(offset)
    return number, offset


def epoch_seconds(date: Column, time: Column) -> Column:
    """UTC seconds of YYYY-MM-DD and hh:mm:ss, fractions dropped; null if either is invalid."""
    year, month, day = (F.regexp_extract(date, _DATE, i).try_cast("int") for i in (1, 2, 3))
    hour, minute = (F.regexp_extract(time, _TIME, i).try_cast("int") for i in (1, 2))
    second = F.floor(F.regexp_extract(time, _TIME, 3).try_cast("double")).cast("long")
    valid = date.rlike(_DATE) & time.rlike(_TIME) & (hour < 24) & (minute < 60) & (second < 60)
    days = F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))
    return F.when(valid, days.cast("long") * 86400 + hour * 3600 + minute * 60 + second)
