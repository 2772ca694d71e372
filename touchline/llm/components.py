"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lookup, release, settle


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, comp) for every linked node; comp is the least node of its component.

    Each round is a table in the shared folder, and the one before it is deleted; a round takes every label's own label
    too, so chains shrink by half. A node with very many links takes part in its joins in several places.
    """
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        near = lookup(both, labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        fresh = settle(lookup(lower, jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        release(labels)
        if fresh.where("old <> comp").isEmpty():
            release(both)
            return fresh.select("node", "comp")
        labels = fresh.select("node", "comp")
