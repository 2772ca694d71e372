"""What the operators share of sessions, tables and the folder that all executors see."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settled import delete, settle, shared_folder

__all__ = ["asked_only", "lean", "local_path", "lookup", "release", "settle", "shared_folder", "spare", "table", "tasks"]


def local_path(uri: str) -> str | None:
    """The file path of a URI on a mounted file system, None for any other."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    return uri if "://" not in uri else None


def release(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


#: Rows that go to a Python worker together: texts are long, and a batch is held twice on its way.
BATCH = 1_000


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def lean(spark: SparkSession) -> SparkSession:
    """Hold the batches of Python workers small in this session, and let workers find this package where the driver has it."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), ROOT])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH:
        spark.conf.set(name, str(BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of one key that are joined in one place, and hot keys that are broadcast at most.
SALT, HOT = 4_000, 1_000_000


def lookup(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a right side of one row a key, where a third of the left side may have one key: rows of a hot key are dealt to several places, and the right side's row is copied to each."""
    many = settle(left.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SALT).select(on, F.ceil(F.col("_n") / SALT).cast("int").alias("_salts")))
    hot = many.count()
    if not hot:
        return left.join(right, on, how)
    many = F.broadcast(many) if hot <= HOT else many
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_salts")), F.lit(0)).cast("int")
    dealt = left.join(many, on, "left").select(*left.columns, salt.alias("_salt"))
    copied = right.join(many, on, "left").select(*right.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
    return dealt.join(copied, [on, "_salt"], how).drop("_salt")


def spare(df: DataFrame, name: str) -> str:
    """The name, with marks at its end if the frame has a column that is called so."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


#: Rows up to which a filter keeps others out of a shuffle, and its bits for each; beyond, all are shuffled.
ASKED, BITS = 1 << 26, 16


def asked_only(docs: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of docs whose keys may be in asked; none that is gets lost. The filter grows with what is asked for, up to 128 MB."""
    n = asked.count()
    if n > ASKED:
        return docs
    bits = 1 << max(10, (n * BITS - 1).bit_length() - 1)
    slices = max(1, min(tasks(docs.sparkSession), bits >> 8))
    place = F.xxhash64(*keys)
    at = asked.select(F.pmod(place, F.lit(slices)).cast("int").alias("slice"), F.pmod(F.shiftright(place, 16), F.lit(bits // slices)).cast("int").alias("bit"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            which, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(which).tolist():
                found.setdefault(k, np.zeros(bits // slices, bool))[bit[which == k]] = True
        for k, marks in found.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    filled = np.zeros((slices, -(-(bits // slices) // 8)), np.uint8)
    for r in at.repartitionById(slices, "slice").mapInArrow(fill, "slice int, bits binary").toLocalIterator():
        filled[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy()
        bit = (h >> 16) % (bits // slices)
        return pd.Series(shared.value[h % slices, bit >> 3] >> (7 - (bit & 7)) & 1 > 0)

    return docs.where(may(place))
