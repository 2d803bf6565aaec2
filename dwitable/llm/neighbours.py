"""Nearest neighbours by low-dimensional stable projections and a kd-tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 11
LEAF = 64


def chi_square_quantile(freedom: int, share: float) -> float:
    """The value that a chi-squared variable stays below with chance ``share``; ``freedom`` is even."""
    low, high = 0.0, 1e3

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def projection(dimensions: int, projected: int) -> np.ndarray:
    """Independent normal entries: the square of a projected length is that length's square times a chi-squared variable."""
    return np.random.default_rng((SEED, dimensions, projected)).standard_normal((dimensions, projected))


class Index:
    """A kd-tree over the projections of some vectors. Equal vectors are one point with its smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, projected: int, confidence: float):
        self.k, self.limit = k, chi_square_quantile(projected, confidence)
        vectors = np.ascontiguousarray(vectors + 0.0)  # no negative zero
        lines = vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, group = np.unique(lines, return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        ids, group = ids[order], group[order]
        fresh = np.append(True, (ids[1:] != ids[:-1]) | (group[1:] != group[:-1]))
        ids, group = ids[fresh], group[fresh]
        cuts = np.searchsorted(group, np.arange(len(first) + 1))
        self.ids = [ids[a : min(b, a + k + 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.vectors = vectors[first]
        self.matrix = projection(vectors.shape[1], projected)
        points = self.vectors @ self.matrix
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            spread = np.ptp(points[rows], axis=0)
            if len(rows) <= LEAF or not spread.any():
                leaves.append(rows)
                continue
            half = len(rows) // 2
            rows = rows[np.argpartition(points[rows, spread.argmax()], half)]
            todo += [rows[:half], rows[half:]]
        self.leaves = leaves
        self.low = np.stack([points[r].min(axis=0) for r in leaves])
        self.high = np.stack([points[r].max(axis=0) for r in leaves])

    def search(self, own: int, query: np.ndarray) -> list[tuple[float, int]]:
        """The nearest found, nearest first, ties to smaller ids; the id ``own`` is left out.

        Leaves are visited in the order of their projected distance. Once k are found, the next leaf's distance is compared
        with the k-th: a point nearer than that would have been projected inside what was visited, but for the chance that the
        chi-square test allows.
        """
        at = query @ self.matrix
        apart = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        reach = (apart * apart).sum(axis=1)
        found: list[tuple[float, int]] = []
        bound = math.inf
        for leaf in np.argsort(reach, kind="stable"):
            if len(found) == self.k and reach[leaf] >= self.limit * bound:
                break
            rows = self.leaves[leaf]
            off = self.vectors[rows] - query
            square = (off * off).sum(axis=1)
            near = np.flatnonzero(square <= bound)
            if near.size:
                found += [(float(square[i]), int(x)) for i in near for x in self.ids[rows[i]] if x != own]
                found = sorted(found)[: self.k]
                if len(found) == self.k:
                    bound = found[-1][0]
        return found


def usable(embedding: str) -> Column:
    """Whether a vector takes part: not null or empty, all numbers finite, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, projected: int = 8, confidence: float = 0.99,
            shard_rows: int = 8192) -> DataFrame:
    """The ``k`` nearest vectors of every query by Euclidean distance: ``(query_id, rank, vec_id, score)``.

    Vectors are dealt out by a hash of their id into shards of about ``shard_rows``. A task holds one shard with its index;
    the queries pass it in blocks, and the shards' results are merged by query. Vectors are projected to ``projected``
    dimensions (an even number); a search stops when anything nearer had been seen with the chance ``confidence``. Scores are
    distances of the original vectors in double precision; ties go to the smaller vec_id, and ranks count from 1.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows without an id. Only vectors
    of the query's length are its candidates. A candidate with the query's id is the query itself. Rows that repeat id and vector
    count once; of several vectors with one id each is a candidate, and the least of them is the query. Equal vectors are
    verified as one. With fewer candidates than ``k`` all are returned. Empty tables give an empty result.
    """
    def clean(df: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>").alias("embedding")
        return df.where("vec_id is not null").where(usable("embedding")).select(F.col("vec_id").cast("long"), vector)

    rows, asked = clean(vectors), clean(queries).groupBy("vec_id", F.size("embedding").alias("size")).agg(F.min("embedding").alias("embedding"))
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    held = rows.select(F.size("embedding").alias("size"), shard.alias("shard"), F.lit(False).alias("query"), "vec_id", "embedding")
    passing = asked.select("size", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"),
                           "vec_id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, index = None, [], [], None
        for batch in batches:
            size, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            query, vec_id = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            keys = np.stack([size, number, query.astype(np.int32)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            out: list[tuple[int, int, float]] = []
            for a, b in zip([0, *cuts], [*cuts, len(size)], strict=True):
                if a == b:
                    continue
                block = batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(b - a, size[a])
                if (size[a], number[a]) != place:
                    place, ids, parts, index = (size[a], number[a]), [], [], None
                if not query[a]:
                    ids.append(vec_id[a:b])
                    parts.append(block)
                    continue
                if index is None and ids:
                    index = Index(np.concatenate(ids), np.concatenate(parts), k, projected, confidence)
                    ids, parts = [], []
                if index is not None:
                    for own, vector in zip(vec_id[a:b].tolist(), block, strict=True):
                        out += [(own, x, math.sqrt(d)) for d, x in index.search(own, vector)]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                       pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    met = held.unionByName(passing).repartition("size", "shard").sortWithinPartitions("size", "shard", "query")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
