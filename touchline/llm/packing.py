"""Operator 2: best-fit packing of documents into sequences of several permitted lengths.

A document counts as many tokens as it has words. Documents longer than the longest sequence are cut into pieces of that
length and a rest. All permitted lengths are weighed together: a new bin opens at the length whose cost is least per token
that the waiting pieces would fill it with, each time the largest that fits, counted at the length that it could shrink to;
a piece goes into the open bin that it fits best; when all pieces lie, each bin shrinks to the cheapest length that still
holds its contents. As a trial leaves out that waiting pieces may fit other open bins better, a group is also packed with
bins opened at no less than each permitted length, and the packing of least total cost is kept.

Pieces are dealt to groups of bounded size by a hash of their document and text, and each group is packed by itself,
largest piece first. No piece is dropped: one without tokens gets a place of length 0. Null texts count as empty, very long
ones are cut into pieces. Documents with equal ids are packed one by one; ties go by doc_id. An empty table gives no rows;
columns other than key and text are not read.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import text_blocks, words
from .shared import lean, settle, table

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces of a group, about.
GROUP = 20_000
#: A sequence's cost over its length grows by its share of so many tokens: attention is quadratic.
QUADRATIC = 16_384


def cost(length: int) -> float:
    return length * (1 + length / QUADRATIC)


def filled(below: Sequence[int], sums: Sequence[int], at: int, length: int) -> int:
    """Tokens that pieces from `at` on put into an empty bin, each time the largest that fits. below: sizes negated; sums: of the sizes before each."""
    used = 0
    while at < len(below) and used < length:
        end = bisect.bisect_right(sums, sums[at] + length - used) - 1
        used += sums[end] - sums[at]
        at = bisect.bisect_left(below, used - length, end)
    return used


def opening(below: Sequence[int], sums: Sequence[int], at: int, lengths: Sequence[int]) -> int:
    """The length, of ordered ones, at which piece `at` opens a bin."""

    def price(length: int) -> tuple[float, int]:
        used = filled(below, sums, at, length)
        return cost(next(x for x in lengths if x >= used)) / max(used, 1), length

    return min((x for x in lengths if x >= -below[at]), key=price)


def fill(sizes: Sequence[int], lengths: Sequence[int], open_at: Callable[[int], int]) -> tuple[list[int], list[int], list[int]]:
    """Best fit with bins opened at `open_at(piece)`, then shrunk: each piece's bin and offset, and each bin's length."""
    room: list[tuple[int, int]] = []  # (what is left, bin), ordered
    used: list[int] = []
    bins, offsets = [], []
    for i, size in enumerate(sizes):
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            k, left = len(used), open_at(i)
            used.append(0)
        bins.append(k)
        offsets.append(used[k])
        used[k] += size
        if left - size:
            bisect.insort(room, (left - size, k))
    return bins, offsets, [next(x for x in lengths if x >= u) for u in used]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """sizes: in falling order, none above the longest length. Returns each piece's bin and offset, and each bin's length after downsizing. Of all ways to open bins (by a trial, or at no less than each of the lengths) the one with the least total cost."""
    lengths = sorted(lengths)
    below, sums = [-x for x in sizes], [0, *itertools.accumulate(sizes)]
    ways = [lambda i: opening(below, sums, i, lengths)]
    ways += [lambda i, least=least: next(x for x in lengths if x >= max(least, sizes[i])) for least in lengths]
    return min((fill(sizes, lengths, way) for way in ways), key=lambda made: sum(map(cost, made[2])))


def count_words(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in text_blocks(batch.column(1)):
                _, _, of = words(data, offsets)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.bincount(of, minlength=j - i)), batch.column(2).slice(i, j - i)], names=[key, "n_tokens", "_place"])

    return df.select(key, text, "_place").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, _place long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """One row a piece: the document, the piece's number, first token and tokens, the bin (group, number), its length and the piece's offset in it."""
    lean(df.sparkSession)
    longest = max(lengths)
    hashed = df.select(F.col(key), F.col(text), F.xxhash64(key, text).alias("_place"))
    counted = settle(count_words(hashed, key, text))
    groups = max(1, -(-(counted.agg(F.sum(F.greatest(F.ceil(F.col("n_tokens") / longest), F.lit(1)))).first()[0] or 0) // GROUP))
    full = F.floor(F.col("n_tokens") / longest).cast("int")
    pieces = counted.select(
        key,
        F.explode(F.sequence(F.lit(0), F.greatest(F.when(F.col("n_tokens") % longest == 0, full - 1).otherwise(full), F.lit(0)))).alias("piece"),
        F.col("n_tokens").alias("_all"),
        "_place",
    ).select(key, "piece", "_place", (F.col("piece").cast("long") * longest).alias("first_token"), F.least(F.lit(longest).cast("long"), F.col("_all") - F.col("piece").cast("long") * longest).alias("n_tokens"))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("_place", "piece"), F.lit(groups))).drop("_place")

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[("n_tokens", "descending"), (key, "ascending"), ("piece", "ascending")]))
        bins, offsets, made = pack(group["n_tokens"].to_pylist(), lengths)
        for name, values in (("bin_number", bins), ("offset", offsets), ("bin_length", [made[k] for k in bins])):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    kind = df.schema[key].dataType.simpleString()
    return dealt.groupBy("bin_group").applyInArrow(run, f"{key} {kind}, piece int, first_token long, n_tokens long, bin_group long, bin_number long, offset long, bin_length long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: where every document's pieces lie."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every piece of every document, with its place."""
    return pack_documents(docs)
