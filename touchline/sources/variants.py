"""Checked reads of JSON documents held as variants.

A variant cast would turn the text "7" or true into 7, so every read looks at the stored type first. Reads add their
complaint to a list; the first complaint of a record, in reading order, becomes its error column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ORD
from ..settled import settle


class InvalidSource(ValueError):
    """A file that can't be read as what it should be."""


def kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_number(k: Column) -> Column:
    return k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")


_KINDS = {"int": is_number, "bigint": is_number, "double": is_number, "string": lambda k: k == "STRING"}


def integer(v: Column, path: str) -> Column:
    """A number as a long, fractions dropped; null for anything else."""
    return F.when(is_number(kind(v, path)), F.try_variant_get(v, path, "bigint"))


class Record:
    """Reads of one variant column, with the complaints that they make.

    What is read of a path becomes a column, its kind first and then its value, so that the many expressions that use it
    neither look it up nor compile it again. `bound` adds these columns to the rows; `name` tells records of one frame apart.
    """

    def __init__(self, v: Column, name: str = "r"):
        self.v, self.name = v, name
        self.errors: list[Column] = []
        self.levels: tuple[dict[str, Column], dict[str, Column]] = ({}, {})
        self.complain(~self.is_object("$"), "expected an object")

    def bound(self, rows: DataFrame) -> DataFrame:
        for level in self.levels:
            rows = rows.withColumns(level) if level else rows
        return rows

    def kind(self, path: str) -> Column:
        name = f"_{self.name}_kind_{path}"
        self.levels[0].setdefault(name, kind(self.v, path))
        return F.col(f"`{name}`")

    def value(self, path: str, type_: str) -> Column:
        """The value, null where it has another kind."""
        name = f"_{self.name}_{type_}_{path}"
        self.levels[1].setdefault(name, F.when(_KINDS[type_](self.kind(path)), F.try_variant_get(self.v, path, type_)))
        return F.col(f"`{name}`")

    def absent(self, path: str) -> Column:
        return self.kind(path).isNull() | (self.kind(path) == "VOID")

    def is_object(self, path: str) -> Column:
        return F.coalesce(self.kind(path).startswith("OBJECT"), F.lit(False))

    def is_array(self, path: str) -> Column:
        return F.coalesce(self.kind(path).startswith("ARRAY"), F.lit(False))

    def complain(self, condition: Column, text: str | Column) -> None:
        self.errors.append(F.when(F.coalesce(condition, F.lit(False)), F.lit(text) if isinstance(text, str) else text))

    def required(self, path: str, type_: str) -> Column:
        self.complain(self.absent(path), f"field '{path.rpartition('.')[2]}' is missing")
        return self.optional(path, type_)

    def optional(self, path: str, type_: str) -> Column:
        value = self.value(path, type_)
        self.complain(~self.absent(path) & value.isNull(), f"field '{path.rpartition('.')[2]}' has the wrong type")
        return value

    def object(self, path: str, required: bool = False) -> None:
        name = path.rpartition(".")[2]
        if required:
            self.complain(self.absent(path), f"field '{name}' is missing")
        self.complain(~self.absent(path) & ~self.is_object(path), f"field '{name}' is no object")

    def point(self, path: str) -> tuple[Column, Column]:
        """The first two numbers of an array, or nulls if there is none."""
        x, y = (self.value(f"{path}[{i}]", "double") for i in (0, 1))
        numbers = self.is_array(path) & x.isNotNull() & y.isNotNull()
        self.complain(~self.absent(path) & ~numbers, f"field '{path.rpartition('.')[2]}' is no pair of numbers")
        return F.when(numbers, x), F.when(numbers, y)

    def error(self, *more: Column) -> Column:
        return F.coalesce(*self.errors, *more, F.lit(None).cast("string"))


#: What closes an object: files are read in pieces that end with it, so that no task holds a whole file.
CLOSE = "}"
_SPACE = "[ \\t\\r\\n]*"


def _depth(text: Column) -> Column:
    """Objects and arrays that a piece opens, less those that it closes."""
    return F.length(F.translate(text, "}]", "")) - F.length(F.translate(text, "{[", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, group, ended): pieces of files, and the group of each: pieces up to the end of an element that is an object. What follows the last object is a group that doesn't end.

    Whether a brace is one, or stands in a string, depends on all that comes before it: each piece tells of its quotes and
    of its braces in both cases, and sums over the file's pieces decide. No piece ends within an escape, as \\} is none.
    """
    pieces = spark.read.option("lineSep", CLOSE).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rest = F.regexp_replace(plain, r'\A[^"]*("|\z)', "")
    outside = lambda text: F.regexp_replace(text, r'"[^"]*("|\z)', "")
    pieces = pieces.withColumns({"quotes": F.length(plain) - F.length(F.translate(plain, '"', "")), "if_outside": _depth(outside(plain)), "if_inside": _depth(outside(rest))})
    by = Window.partitionBy("file").orderBy("block", "at")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("inside", F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0)))
    closes = (F.col("inside") + F.col("quotes")) % 2 == 0
    pieces = pieces.withColumn("depth", F.sum(F.when(F.col("inside") == 1, F.col("if_inside")).otherwise(F.col("if_outside")) - closes.cast("int")).over(upto))
    pieces = pieces.withColumn("ended", closes & (F.col("depth") == 1))
    return pieces.withColumn("group", F.coalesce(F.sum(F.col("ended").cast("long")).over(before), F.lit(0))).select("file", "block", "at", "value", "group", "ended")


def records(spark: SparkSession, path: str, what: str) -> DataFrame:
    """The elements of a JSON array as (file, _ord, v). A path may name many files; each is an array of its own. Files are parsed once, element by element: checks and results read the parsed elements from a shared table."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"])
    groups = _pieces(spark, path).groupBy("file", "group").agg(F.array_join(in_order, CLOSE).alias("text"), F.bool_or("ended").alias("ended"))
    # an element follows the bracket or a comma; the last group ends with the bracket, and has elements after a comma only
    first, last = F.col("group") == 0, ~F.col("ended")
    head = F.when(first, F.lit(rf"\A{_SPACE}\[")).otherwise(rf"\A{_SPACE},")
    over = F.coalesce(last & ~first & F.col("text").rlike(rf"\A{_SPACE}\]{_SPACE}\z"), F.lit(False))
    body = F.regexp_replace("text", head, F.lit(""))
    body = F.when(last, F.regexp_replace(body, rf"\]{_SPACE}\z", "")).otherwise(F.concat(body, F.lit(CLOSE)))
    sound = F.regexp_like("text", head) & (~last | F.col("text").rlike(rf"\]{_SPACE}\z")) & (first & last | ~body.rlike(rf"\A{_SPACE}\z"))
    groups = groups.withColumn("doc", F.when(over, F.parse_json(F.lit("[]"))).when(sound, F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))))
    shape = F.when(first & ~F.col("text").rlike(rf"\A{_SPACE}\["), "other").when(F.col("doc").isNull(), "malformed")
    groups = groups.select("file", "group", last.alias("_last"), shape.alias("_shape"), "doc")
    found = settle(spark.sql(f"select file, _last, _shape, group + pos as {ORD}, value as v from {{groups}}, lateral variant_explode_outer(doc)", groups=groups), clean=True)
    told = found.groupBy("file").agg(F.coalesce(F.max("_shape"), F.when(~F.bool_or("_last"), "malformed")).alias("shape")).where("shape is not null")
    wrong = told.groupBy("shape").agg(F.min("file").alias("file"), F.collect_list("file").alias("files")).collect()
    wrong = {r["shape"]: r for r in wrong}
    malformed = [wrong["malformed"]["file"]] if "malformed" in wrong else []
    if "other" in wrong:
        whole = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").isin(wrong["other"]["files"]) & F.try_parse_json("value").isNull())
        malformed += [r["file"] for r in whole.agg(F.min("_metadata.file_path").alias("file")).collect() if r["file"]]
    if malformed:
        raise InvalidSource(f"{what} file '{min(malformed)}' is not JSON")
    if wrong:
        raise InvalidSource(f"{what} file '{wrong['other']['file']}': expected an array at the top")
    return found.where(f"{ORD} is not null").select("file", ORD, "v")
