"""Metrica event files: CSV with a header, quotes doubled, no line breaks inside fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pitch import METRICA_PITCH, attacks_left, canonical, on_pitch
from ..functions.text import title_case
from ..functions.times import split_seconds
from ..schema import ORD
from ..settled import settle
from .statsbomb import finished, match_column
from .variants import InvalidSource

PROVIDER = "Metrica"
# fixed values: the columns that every file has
REQUIRED = ("Team", "Type", "Subtype", "Period", "Start Frame", "Start Time [s]", "From", "Start X", "Start Y", "End X", "End Y")
LEFT_TO_RIGHT, RIGHT_TO_LEFT = "left-to-right", "right-to-left"


def event_identifier(match_id: Column, start_frame: Column, index: Column) -> Column:
    """The files have no ids; this one is unique within its match."""
    return F.concat_ws(":", F.lit("metrica"), match_id.cast("string"), F.coalesce(start_frame, F.lit("")), index.cast("string"))


def coordinate_number(text: Column) -> Column:
    """A coordinate, null if it is missing: empty, NaN or nan."""
    return F.when(~missing(text), text.try_cast("double"))


def missing(text: Column) -> Column:
    return text.isNull() | text.isin("", "NaN", "nan")


def split_header(line: str) -> list[str]:
    out, field, quoted = [], "", False
    for i, c in enumerate(line):
        if c == '"' and quoted and line[i + 1 : i + 2] == '"':
            field += c
            quoted = None  # the next mark belongs to this one
        elif c == '"' and quoted is None:
            quoted = True
        elif c == '"' and (quoted or not field):
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(field)
            field = ""
        else:
            field += c
    if quoted:
        raise InvalidSource("Metrica header: a quoted name has no end")
    return [*out, field]


def checked_header(line: str, file: str) -> list[str]:
    names = split_header(line)
    if len(set(names)) < len(names) or "" in names:
        raise InvalidSource(f"Metrica file '{file}': header has empty or repeated names")
    if lacking := [n for n in REQUIRED if n not in names]:
        raise InvalidSource(f"Metrica file '{file}': header lacks '{lacking[0]}'")
    return names


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, line, index, value) of every line of every file that isn't blank, but for headers; index counts them from 0. A file is read by one task, and its lines are numbered as its array is taken apart."""
    lines = F.transform(F.split("value", "\n"), lambda v, i: F.struct(i.alias("line"), F.regexp_replace(v, "\r$", "").alias("value")))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), lines.alias("lines"))
    body = F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: x["value"] != "")
    exploded = whole.select("file", F.get("lines", F.lit(0))["value"].alias("header"), F.posexplode_outer(body).alias("index", "at"))
    return exploded.select("file", "header", (F.col("at.line") + 1).cast("long").alias("csv_row"), F.col("index").cast("long"), F.col("at.value").alias("value"))


def load_events(spark: SparkSession, path: str, match_id: int | Column, home_first_half_direction: str | None) -> DataFrame:
    """All events in file order. Points off the pitch keep their source coordinates and have no canonical ones. A path may name many files, each with a header of its own; match_id may then be an expression over `file`."""
    if home_first_half_direction not in (LEFT_TO_RIGHT, RIGHT_TO_LEFT):
        raise ValueError("Metrica import requires the home team's first-half direction")
    first = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "").alias("header")
    headers = {r["header"]: r["file"] for r in spark.read.text(path, wholetext=True).select(first, F.col("_metadata.file_path").alias("file")).groupBy("header").agg(F.min("file").alias("file")).collect()}
    if not headers or not all(headers):
        raise InvalidSource(f"Metrica event file '{headers.get('', path)}' is empty")
    lines = numbered_lines(spark, path).where(F.col("index").isNotNull())
    parts = [_events(lines.where(F.col("header") == header), checked_header(header, file), match_id, home_first_half_direction) for header, file in sorted(headers.items())]
    return reduce(DataFrame.unionByName, parts)


def _events(lines: DataFrame, names: list[str], match_id: int | Column, home_first_half_direction: str) -> DataFrame:
    """Events of the files with one header."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_bad", T.StringType())])
    parsed = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"', "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    # each line is parsed once: the optimizer would parse it anew for each field that is read of it
    rows = settle(lines.select("file", F.col("csv_row").alias(ORD), "index", "value", parsed.alias("row")))
    get = lambda name: F.col(f"row.c{names.index(name)}")
    errors: list[Column] = []
    complain = lambda condition, message: errors.append(F.when(F.coalesce(condition, F.lit(False)), F.lit(message)))
    complain(F.length(F.translate("value", '"', "")) % 2 != F.length("value") % 2, "a quoted field has no end")
    complain(F.col("row._bad").isNotNull(), "the number of fields differs from the header's")
    period, team = get("Period").try_cast("int"), get("Team")
    complain(~F.coalesce(get("Period").rlike(r"^-?\d+$"), F.lit(False)) | period.isNull(), "'Period' is no integer")
    complain(~period.isin(1, 2), "Period is neither 1 nor 2")
    complain(team.isNull() | ~team.isin("Home", "Away"), "Team is neither 'Home' nor 'Away'")
    seconds = get("Start Time [s]").try_cast("double")
    complain(seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")), "'Start Time [s]' is no finite number")
    complain(seconds < 0, "Start Time [s] is negative")
    complain(get("Type").isNull() | (get("Type") == ""), "Type is empty")
    millis, minute, second = split_seconds(seconds)
    some = lambda c: F.nullif(c, F.lit(""))
    fields = {
        "provider_event_id": event_identifier(match_column(match_id), get("Start Frame"), F.col("index")),
        "match_id": match_column(match_id),
        "period": period,
        "timestamp": millis,
        "minute": minute,
        "second": second,
        "team_name": team,
        "player_name": some(get("From")),
        "event_type": title_case(get("Type")),
        "outcome": some(get("Subtype")),
        "provider": F.lit(PROVIDER),
    }
    left = attacks_left(team, period, F.lit(home_first_half_direction == LEFT_TO_RIGHT))
    for point, (x_name, y_name) in {"start": ("Start X", "Start Y"), "end": ("End X", "End Y")}.items():
        x, y = coordinate_number(get(x_name)), coordinate_number(get(y_name))
        complain(missing(get(x_name)) != missing(get(y_name)), f"of '{x_name}' and '{y_name}' only one is given")
        for name, value in ((x_name, x), (y_name, y)):
            complain(~missing(get(name)) & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))), f"'{name}' is no finite number")
        nx, ny = canonical(x, y, *METRICA_PITCH, left)
        inside = on_pitch(x, y, *METRICA_PITCH)
        fields |= {f"source_{point}_x": x, f"source_{point}_y": y, f"{point}_x": F.when(inside, nx), f"{point}_y": F.when(inside, ny)}
    # errors name the line in the file, counted from 1 with the header
    out = finished(rows, fields, F.coalesce(*errors, F.lit(None).cast("string")), PROVIDER + " event on line {}")
    return out.withColumn(ORD, F.element_at(F.split("provider_event_id", ":"), -1).cast("long"))
