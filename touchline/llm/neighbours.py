"""Operator 10: nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt to cells by the nearest of a few pivots, drawn by a hash; a cell with more than a shard's vectors has
several shards. Each shard's tree splits its vectors at the median distance from a vantage point. Largest inner product
becomes least distance by one more coordinate: with M the greatest norm of all vectors, a candidate x gets
sqrt(M^2 - |x|^2), a query 0, and the squared distance is M^2 + |q|^2 - 2 q.x. A query skips a subtree whose least
possible distance, by the triangle inequality, times `factor` exceeds its worst kept distance; factor 1 skips nothing
that could matter, so the search is exact; greater factors skip more.

A query first searches the cell that it lies in. Its k-th score there decides which other cells it goes to: with pivot p
and radius r, no vector of a cell scores above q.p + |q| r, nor above |q| times the cell's greatest norm. Answers are
merged by query.

Vectors that are null, zero, of another length than the most common, or hold null or non-finite components take no part;
neither do vectors whose squared length isn't finite, nor rows without an id. Equal scores go to the smaller id;
candidates that repeat an id stand for one vector each, queries that repeat id and vector for one (a query never finds
rows of its own id). With fewer candidates than asked for, all are returned. An empty table gives no rows; columns other
than id and vector are not read, and vectors of any length are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lean, settle, table

#: Vectors of a shard at most, about, and pivots at most.
SHARD, PIVOTS = 16_384, 1_024
#: Queries that go through a tree together.
BLOCK = 2_048
LEAF = 512
#: 1.0 is exact.
FACTOR = 1.0


class VantageTree:
    """A tree over the rows of `points`; nodes hold (vantage point, radius, inner, outer) or a slice of `order`."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(points))

    def _build(self, a: int, b: int) -> int:
        mine = len(self.nodes)
        self.nodes.append(())
        if b - a <= self.leaf:
            self.nodes[mine] = (a, b)
            return mine
        part = self.order[a:b]
        # of a few points, the one whose distances spread the most
        tried = part[np.linspace(0, len(part) - 1, 5).astype(int)]
        probe = self.points[part[:: max(1, len(part) // 256)]]
        vantage = max(tried, key=lambda i: np.std(np.linalg.norm(probe - self.points[i], axis=1)))
        far = np.linalg.norm(self.points[part] - self.points[vantage], axis=1)
        half = len(part) // 2
        rank = np.argpartition(far, half)
        self.order[a:b] = part[rank]
        radius = far[rank[half]]
        low = (far[rank[:half]].min(), far[rank[:half]].max())
        high = (far[rank[half:]].min(), far[rank[half:]].max())
        self.nodes[mine] = (self.points[vantage], radius, low, high, self._build(a, a + half), self._build(a + half, b))
        return mine

    def search(self, queries: np.ndarray, worst: np.ndarray, factor: float, visit) -> None:
        """Calls visit(rows of queries, slice of order) for each leaf that may hold better points than a query's worst; visit returns nothing but lowers self.worst."""
        self.worst = worst
        seen: dict[int, np.ndarray] = {}
        # first each query's own leaf, so that the bounds are tight from the start
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            entry = self.nodes[node]
            if len(entry) == 2:
                visit(rows, entry)
                seen[node] = rows
                continue
            inside = np.linalg.norm(queries[rows] - entry[0], axis=1) < entry[1]
            todo += [(entry[4], rows[inside]), (entry[5], rows[~inside])]
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            entry = self.nodes[node]
            if len(entry) == 2:
                rows = np.setdiff1d(rows, seen[node], assume_unique=True) if node in seen else rows
                if len(rows):
                    visit(rows, entry)
                continue
            far = np.linalg.norm(queries[rows] - entry[0], axis=1)
            for (least, most), child in ((entry[2], entry[4]), (entry[3], entry[5])):
                bound = np.maximum(np.maximum(least - far, far - most), 0.0)
                on = rows[bound * factor <= self.worst[rows] * (1 + 1e-12) + 1e-12]
                if len(on):
                    todo.append((child, on))


def best_of_shard(vectors: np.ndarray, ids: np.ndarray, query_blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, factor: float, top: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores) of each block's k best in this shard. Blocks hold ids, vectors, and a score that k candidates elsewhere reach."""
    lifted = np.column_stack((vectors, np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", vectors, vectors), 0.0))))
    tree = VantageTree(lifted)
    for own, queries, reached in query_blocks:
        n = len(queries)
        wide = np.column_stack((queries, np.zeros(n)))
        length = np.einsum("ij,ij->i", queries, queries) + top * top
        score = np.full((n, k), -np.inf)
        found = np.full((n, k), np.iinfo(np.int64).max)

        def visit(rows: np.ndarray, entry: tuple[int, int]) -> None:
            part = tree.order[entry[0] : entry[1]]
            got = queries[rows] @ vectors[part].T
            got[own[rows][:, None] == ids[part][None, :]] = -np.inf
            s = np.concatenate((score[rows], got), axis=1)
            names = np.concatenate((found[rows], np.broadcast_to(ids[part], got.shape)), axis=1)
            if s.shape[1] > 4 * k:
                # all that reach the k-th best score stay until ties are settled by id
                edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                widest = int((s >= edge[:, None]).sum(axis=1).max())
                at = np.argpartition(-s, min(widest, s.shape[1] - 1), axis=1)[:, :widest]
                s, names = np.take_along_axis(s, at, 1), np.take_along_axis(names, at, 1)
            at = np.lexsort((names, -s), axis=1)[:, :k]
            score[rows], found[rows] = np.take_along_axis(s, at, 1), np.take_along_axis(names, at, 1)
            tree.worst[rows] = np.minimum(tree.worst[rows], reach(rows, score[rows, -1]))

        def reach(rows, scores: np.ndarray) -> np.ndarray:
            return np.where(np.isfinite(scores), np.sqrt(np.maximum(length[rows] - 2 * scores, 0.0)), np.inf)

        tree.search(wide, reach(slice(None), reached), factor, visit)
        row, at = np.nonzero(np.isfinite(score))
        yield own[row], found[row, at], score[row, at]


class Cells:
    """Pivots, and of each cell its number of vectors, radius, greatest norm and shards."""

    def __init__(self, pivots: np.ndarray, shard: int):
        self.pivots, self.shard = pivots, shard

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector, and its distance from the pivot, from the difference itself."""
        half = 0.5 * np.einsum("ij,ij->i", self.pivots, self.pivots)
        cell = np.concatenate([np.argmax(vectors[i : i + 4096] @ self.pivots.T - half, axis=1) for i in range(0, len(vectors), 4096)]) if len(vectors) else np.empty(0, np.int64)
        return cell, np.linalg.norm(vectors - self.pivots[cell], axis=1)

    def settle(self, rows: list) -> None:
        n = len(self.pivots)
        count, self.radius, self.norm = np.zeros(n, np.int64), np.full(n, -np.inf), np.full(n, -np.inf)
        for r in rows:
            count[r["_cell"]], self.radius[r["_cell"]], self.norm[r["_cell"]] = r["n"], r["radius"] * (1 + 1e-9), r["norm"] * (1 + 1e-9)
        self.shards = -(-count // self.shard)
        self.first = np.cumsum(self.shards) - self.shards
        self.total = int(self.shards.sum())

    def further(self, queries: np.ndarray, reached: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query's row, cell) of all cells but its own in which a vector might reach the score."""
        length = np.linalg.norm(queries, axis=1)[:, None]
        with np.errstate(invalid="ignore"):
            most = np.minimum(queries @ self.pivots.T + length * self.radius, length * self.norm)
        may = (most >= reached[:, None] - 1e-9 * (1 + np.abs(reached))[:, None]) & (self.shards > 0)
        may[np.arange(len(queries)), own] = False
        return np.nonzero(may)

    def at(self, cell: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All shards of given cells, and the row that asks for each."""
        n = self.shards[cell]
        return np.repeat(self.first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(of, n)


VECTORS = "_shard int, _asks boolean, _id long, _v array<double>, _reached double"


def nearest(df: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The k nearest of every query row: query_id, rank from 1, vec_id, score."""
    spark = lean(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("_id"), F.transform(vector, lambda x: x.cast("double")).alias("_v"), is_query.alias("_asks"))
    rows = rows.where(F.col("_id").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0))
    rows = rows.withColumn("_norm", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))).where(F.col("_norm") < float("inf"))
    sizes = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("_norm").alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, top = sizes[0]["d"], sizes[0]["top"] * (1 + 1e-9)
    rows = rows.where(F.size("_v") == width)
    wanted = max(1, min(PIVOTS, -(-sizes[0]["n"] // shard)))
    drawn = rows.select("_v", F.xxhash64("_id", "_v").alias("_hash")).orderBy("_hash").limit(2 * wanted).collect()
    cells = Cells(np.unique(np.array([r["_v"] for r in drawn]), axis=0)[:wanted], shard)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = cells.nearest(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "_cell", "_far"])

    placed = settle(rows.select("_id", "_v", "_asks", "_norm").mapInArrow(assign, "_id long, _v array<double>, _asks boolean, _norm double, _cell int, _far double"))
    cells.settle(placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("radius"), F.max("_norm").alias("norm")).collect())
    first, shards = (F.lit([int(x) for x in v]) for v in (cells.first, cells.shards))
    own = F.get(first, F.col("_cell")) + F.pmod(F.xxhash64("_id", "_v"), F.get(shards, F.col("_cell"))).cast("int")
    stored = placed.select(own.cast("int").alias("_shard"), F.lit(False).alias("_asks"), "_id", "_v", F.lit(0.0).alias("_reached"))
    asked = placed.where("_asks").dropDuplicates(["_id", "_v"]).select("_id", "_v", "_cell")
    everywhere = F.explode(F.sequence(F.get(first, F.col("_cell")), F.get(first, F.col("_cell")) + F.get(shards, F.col("_cell")) - 1).cast("array<int>"))
    near = asked.select(everywhere.alias("_shard"), F.lit(True).alias("_asks"), "_id", "_v", F.lit(float("-inf")).alias("_reached"))

    def searched(queries: DataFrame) -> DataFrame:
        dealt = stored.unionByName(queries).repartitionById(cells.total, F.col("_shard")).sortWithinPartitions("_asks", "_id")
        return settle(dealt.mapInArrow(run, "query_id long, vec_id long, score double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in [*early, *batches]:
                batch = batch.filter(batch.column(1))
                for i in range(0, len(batch), BLOCK):
                    part = batch.slice(i, BLOCK)
                    yield part.column(2).to_numpy(), matrix(part.column(3)), part.column(4).to_numpy()

        early: list[pa.RecordBatch] = []
        for batch in batches:
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            stored = batch.filter(pa.array(~asks))
            ids.append(stored.column(2).to_numpy())
            vectors.append(matrix(stored.column(3)))
            if asks.any():
                early.append(batch)
                break
        if not ids or not early or not sum(map(len, ids)):
            return
        for own, got, s in best_of_shard(np.concatenate(vectors), np.concatenate(ids), blocks(), k, factor, top):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(got), pa.array(s)], names=["query_id", "vec_id", "score"])

    def best(found: DataFrame) -> DataFrame:
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    found = searched(near)
    if len(cells.pivots) > 1:
        reached = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_reached"))

        def send_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                queries, floor = matrix(batch.column(1)), batch.column(3).to_numpy()
                row, cell = cells.further(queries, floor, batch.column(2).to_numpy())
                to, row = cells.at(cell, row)
                for i in range(0, len(to), 10_000):
                    take = pa.array(row[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 10_000].astype(np.int32)), pa.array(np.ones(len(take), bool)), batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take)], names=["_shard", "_asks", "_id", "_v", "_reached"])

        open_ = asked.join(reached, "_id", "left").select("_id", "_v", "_cell", F.coalesce("_reached", F.lit(float("-inf"))).alias("_reached"))
        found = found.unionByName(searched(open_.mapInArrow(send_on, VECTORS)))
    return best(found).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 20 nearest of every vector whose id is divisible by 20, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
