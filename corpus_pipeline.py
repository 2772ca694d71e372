"""The corpus pipeline: documents in, packed sequences out. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm.jaccard import one_of_each
from touchline.llm.packing import pack_stage
from touchline.llm.quality import keep_good
from touchline.llm.repeats import without_repeats
from touchline.llm.shared import settle, table

STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", pack_stage),
]

#: A learnt score, components and byte repeats are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: where each piece of each document that is left lies."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
