"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own centroids, so K centroids a half make
K * K cells. For a query the cells are traversed in the order of the summed distance of
their two centroids (for the inner product: least loss against the best centroid of
each half) with a heap, until the cells passed hold enough rows; those rows are
reranked by the exact measure in double precision.

Training and the number of rows to pass are taken from a bounded sample (SAMPLE vectors
by a hash of their id): the least share of rows that finds RECALL of the true
neighbours of sampled queries, by brute force within the sample. All rows are indexed.

Cells are dealt, in their order, into blocks of at most BLOCK rows; a cell with more
rows is split over several blocks. Each vector is sent to its block once; queries are
sent to the blocks that hold a cell of theirs. A block's task holds its vectors, takes
the queries batch by batch through a matrix product, and sends the best k of each on,
so the rows sent grow with queries times blocks, not with pairs, and a task's memory
with neither.

The centroids grow with the rows (a cell holds about ROWS_A_CELL), up to
MOST_CENTROIDS a half: the table of cells that goes to every task has at most
MOST_CENTROIDS ** 2 entries.

Edge cases: vectors that are null, empty, all zero, or hold null or non-finite
components take no part, nor do those of another length than the most common one (the
smaller one of two), nor rows without id. Rows that share an id are rows of their own:
each is a candidate of the other, and each query row has its own result under that id.
Ties go to the smaller id; with fewer candidates than k all are returned; no vectors,
no result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import cut, table

K_NEAREST = 20
SAMPLE = 20_000
RECALL = 0.96
MOST_CENTROIDS, ROWS_A_CELL = 1024, 16
BLOCK, CHUNK = 16_384, 256


def matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = np.unique(x, axis=0)
    centres = centres[np.sort(rng.choice(len(centres), min(k, len(centres)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        for c in range(len(centres)):
            if (mine := own == c).any():
                centres[c] = x[mine].mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


@dataclass
class Index:
    left: np.ndarray
    right: np.ndarray
    share: float = 1.0

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.left) * len(self.right) + nearest(x[:, self.half :], self.right)

    def traverse(self, q: np.ndarray, count: np.ndarray, enough: int) -> list[int]:
        """Cells by growing summed distance until they hold ``enough`` rows. count: rows of each cell."""
        a, b = self.left @ q[: self.half], self.right @ q[self.half :]
        by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        da, db = (a.max() - a)[by_a].tolist(), (b.max() - b)[by_b].tolist()
        width, out, got = len(by_b), [], 0
        heap, done = [(0.0, 0, 0)], set()
        while heap and got < enough:
            _, i, j = heapq.heappop(heap)
            done.add((i, j))
            cell = by_a[i] * width + by_b[j]
            if count[cell]:
                out.append(cell)
                got += int(count[cell])
            if i + 1 < len(da) and (j == 0 or (i + 1, j - 1) in done):
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
            if j + 1 < width and (i == 0 or (i - 1, j + 1) in done):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        return out


def train(x: np.ndarray, rows: int, k: int = K_NEAREST, recall: float = RECALL) -> Index:
    """x: the sample; rows: of the whole table, from which the number of centroids follows."""
    n = int(min(MOST_CENTROIDS, len(x), max(2, 2 ** round(np.log2(max(2.0, (rows / ROWS_A_CELL) ** 0.5))))))
    half = x.shape[1] // 2
    index = Index(kmeans(x[:, :half], n), kmeans(x[:, half:], n))
    if len(x) > 10 * k:
        q = x[:: max(1, len(x) // 200)]
        true = q @ x.T
        true[np.arange(len(q)), np.arange(len(x))[:: max(1, len(x) // 200)]] = -np.inf
        top = np.argpartition(-true, k, axis=1)[:, :k]
        cell = index.cells(x)
        score = (q[:, :half] @ index.left.T)[:, cell // len(index.right)] + (q[:, half:] @ index.right.T)[:, cell % len(index.right)]
        place = np.empty(score.shape, int)
        np.put_along_axis(place, np.argsort(-score, axis=1, kind="stable"), np.arange(len(x))[None, :], 1)
        index.share = float(min(1.0, np.quantile(np.take_along_axis(place, top, 1), recall) / len(x) + 0.01))
    return index


def usable(vec: Column) -> Column:
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vec.isNotNull() & F.forall(vec, fine) & F.exists(vec, lambda v: v != 0)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of the rows, summed component by component: equal vectors have equal scores wherever they lie."""
    s = np.zeros(len(q))
    for d in range(q.shape[1]):
        s += q[:, d] * x[:, d]
    return s


def _best(qrow: np.ndarray, q: np.ndarray, cells: pa.Array, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, k: int):
    """For each query (its number, the candidates' ids and scores): the best k of a block's rows that lie in its cells."""
    kinds, place = np.unique(cell, return_inverse=True)
    visits = cells.to_pylist()
    for a in range(0, len(qrow), CHUNK):
        z = min(len(qrow), a + CHUNK)
        visited = np.stack([np.isin(kinds, c) for c in visits[a:z]])
        s = np.where(visited[:, place], q[a:z] @ x.T, -np.inf)
        s[qrow[a:z, None] == rows] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if len(rows) > k else np.full(z - a, -np.inf)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        row, col = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        e = exact(q[a + row], x[col])
        order = np.lexsort((rows[col], ids[col], -e, row))
        row, col, e = row[order], col[order], e[order]
        first = np.searchsorted(row, np.arange(z - a + 1))
        for r in np.flatnonzero(np.diff(first)).tolist():
            best = slice(first[r], min(first[r] + k, first[r + 1]))
            yield int(qrow[a + r]), ids[col[best]], e[best]


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, row, id, x, cell (null for a query), cells; a block's vectors before its queries -> row, ids, scores."""
        now, held, index = None, [], None
        for batch in batches:
            block = batch.column(0).to_numpy()
            for a, z in zip(*(lambda s: (s, [*s[1:], len(block)]))(np.flatnonzero(np.diff(block, prepend=-1)).tolist()), strict=True):
                part = batch.slice(a, z - a)
                if block[a] != now:
                    now, held, index = block[a], [], None
                vectors = part.filter(part.column(4).is_valid())
                if vectors.num_rows:
                    held.append(tuple(matrix(vectors.column(c)) if c == 3 else vectors.column(c).to_numpy() for c in (1, 2, 3, 4)))
                queries = part.filter(part.column(4).is_null())
                if not queries.num_rows or not held:
                    continue
                index = index or tuple(np.concatenate(c) for c in zip(*held, strict=True))
                found = list(_best(queries.column(1).to_numpy(), matrix(queries.column(3)), queries.column(5), *index, k))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["row", "ids", "scores"])

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = K_NEAREST, vec_id: str = "vec_id", vec: str = "embedding", recall: float = RECALL, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``is_query`` (over column ``vec_id``) picks, against all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("x")).where("vec_id is not null").where(usable(F.col("x")))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], empty)
    rows, n = rows.where(F.size("x") == lengths["dim"]), lengths["count"]
    if lengths["dim"] < 2:  # one half would be empty
        rows = rows.withColumn("x", F.concat("x", F.array(F.lit(0.0))))
    sample = matrix(rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).select("x").toArrow()["x"])
    index = train(sample, n, k, recall)
    sent = spark.sparkContext.broadcast(index)

    @F.arrow_udf("int")
    def cell_of(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.cells(matrix(x)) if len(x) else [], pa.int32())

    placed = cut(rows.withColumn("cell", cell_of("x")))
    count = np.zeros(len(index.left) * len(index.right), np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MOST_CENTROIDS ** 2 rows
        count[r["cell"]] = r["count"]
    size = min(block_rows, max(512, -(-n // 24)))
    begin = np.cumsum(count) - count
    first, last = begin // size, np.where(count > 0, (begin + count - 1) // size, begin // size)
    enough = max(20 * k, int(np.ceil(index.share * n)))
    plan = spark.sparkContext.broadcast((count, first.astype(np.int32), last.astype(np.int32)))  # at most MOST_CENTROIDS ** 2 cells

    @F.arrow_udf("array<struct<block:int,cells:array<int>>>")
    def visits(x: pa.Array) -> pa.Array:
        count, first, last = plan.value
        out = []
        for q in matrix(x):
            by_block: dict[int, list[int]] = {}
            for c in sent.value.traverse(q, count, enough):
                for b in range(first[c], last[c] + 1):
                    by_block.setdefault(b, []).append(c)
            out.append([{"block": b, "cells": c} for b, c in sorted(by_block.items())])
        return pa.array(out, pa.list_(pa.struct([("block", pa.int32()), ("cells", pa.list_(pa.int32()))])))

    @F.arrow_udf("int")
    def block_of(cell: pa.Array, h: pa.Array) -> pa.Array:
        _, first, last = plan.value
        c = cell.to_numpy()
        return pa.array(first[c] + h.to_numpy() % (last[c] - first[c] + 1), pa.int32())

    queries = placed.where(is_query).select("row", "vec_id", "x", F.explode(visits("x")).alias("v"))
    queries = queries.select("v.block", "row", "vec_id", "x", F.lit(None).cast("int").alias("cell"), "v.cells")
    where = block_of("cell", F.pmod(F.xxhash64("row"), F.lit(1 << 30)))
    vectors_ = placed.select(where.alias("block"), "row", "vec_id", "x", "cell", F.lit(None).cast("array<int>").alias("cells"))
    met = vectors_.unionByName(queries).repartition("block").sortWithinPartitions("block", F.col("cell").isNull())
    best = met.mapInArrow(_score(k), "row long, ids array<long>, scores array<double>")
    pairs = F.arrays_zip(F.flatten(F.collect_list("ids")).alias("vec_id"), F.flatten(F.collect_list("scores")).alias("score"))
    order = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["score"]).alias("far"), p["vec_id"].alias("vec_id"), p["score"].alias("score"))))
    merged = best.groupBy("row").agg(F.slice(order, 1, k).alias("near")).join(placed.where(is_query).select("row", F.col("vec_id").alias("query_id")), "row")
    return merged.select("query_id", F.posexplode("near").alias("pos", "p")).select("query_id", (F.col("pos") + 1).alias("rank"), "p.vec_id", "p.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
