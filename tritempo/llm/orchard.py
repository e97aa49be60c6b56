"""Centroid clustering with Orchard's search.

Vectors are whole numbers, so distances, sums and centroids are exact and don't depend on the order of rows. Every centroid
has a list of the others, nearest first. A vector starts at the centroid whose length is closest to its own and goes through
that centroid's list. A closer centroid, or an equally close one of a smaller number, becomes the vector's own at once and the
search goes on with the list of that one; a centroid it was compared with is marked and not compared again. The search stops at
a centroid farther from the own one than twice the vector's distance: by the triangle inequality neither it nor any later one
can be closer. At exactly twice the distance it goes on, as that one may be equally close.

All vectors of a batch search side by side in the task that reads them. A round sends the sums of each task's vectors, a row for
every centroid and component, which are added up in two levels; vectors are never shuffled. The centroids (``k`` vectors) are
collected and sent to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.llm.common import Scratch

CLUSTERS, ROUNDS, SCALE, SIZE = 16, 3, 64, 64
#: components beyond are taken as this, so that distances fit 64 bits
BOUND = 1 << 27
#: vectors that search side by side
ABREAST = 4096
#: parts in which the rows of tasks are added up first
PARTS = 64
LARGEST = (1 << 63) - 1


def whole_vectors(rows: DataFrame, *, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """(key, cells): the vectors that have ``size`` components, all finite, as whole numbers floor(scale * component)."""
    rows = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce((F.size("vector") == size) & finite, F.lit(False)))
    cell = lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int")
    return rows.select("key", F.transform("vector", cell).alias("cells"))


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """Equally long lists as rows."""
    return np.asarray(pc.list_flatten(column)).reshape(len(column), size)


class Orchard:
    """Searches the nearest of some centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = np.asarray(centroids, np.int64)
        apart = self.centroids[:, None] - self.centroids[None]
        self.apart = np.einsum("ijk,ijk->ij", apart, apart)
        numbers = np.broadcast_to(np.arange(len(apart)), self.apart.shape)
        self.lists = np.lexsort((numbers, self.apart), axis=1)
        self.lists = self.lists[self.lists != np.arange(len(apart))[:, None]].reshape(len(apart), len(apart) - 1)
        self.gaps = np.take_along_axis(self.apart, self.lists, 1)
        self.order = np.argsort(self._lengths(self.centroids), kind="stable")
        self.lengths = self._lengths(self.centroids)[self.order]

    @staticmethod
    def _lengths(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid (the smallest of equals), the squared distance, and how many were compared."""
        x = np.asarray(x, np.int64)
        parts = [self._nearest(x[at : at + ABREAST]) for at in range(0, len(x), ABREAST)]
        return tuple(np.concatenate(each) if each else np.zeros(0, np.int64) for each in (zip(*parts, strict=True) if parts else ((), (), ())))

    def _squared(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[numbers]
        return np.einsum("ij,ij->i", gap, gap)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.arange(len(x))
        own = self.order[np.minimum(np.searchsorted(self.lengths, self._lengths(x)), len(self.order) - 1)]
        best = self._squared(x, own)
        marked = np.zeros((len(x), len(self.centroids)), bool)
        marked[rows, own] = True
        place = np.zeros(len(x), np.int64)
        while len(rows := rows[place[rows] < self.lists.shape[1]]):
            at = own[rows], place[rows]
            # squared: strictly beyond twice the distance; halved so that it can't overflow
            rows = rows[self.gaps[at] / 4 <= best[rows]]
            other = self.lists[own[rows], place[rows]]
            place[rows] += 1
            new = ~marked[rows, other]
            asked, other = rows[new], other[new]
            marked[asked, other] = True
            distance = self._squared(x[asked], other)
            closer = (distance < best[asked]) | ((distance == best[asked]) & (other < own[asked]))
            moved = asked[closer]
            own[moved], best[moved], place[moved] = other[closer], distance[closer], 0
        return own, best, marked.sum(1)


def first_centroids(vectors: DataFrame, rows: int, k: int, seed: str = "1") -> np.ndarray:
    """The cells of the ``k`` vectors with the smallest sha256 of seed and key, in that order; fewer if there are no more.

    Hashes are evenly spread, so those below a bound are about as many as its share of all rows; the bound grows until there
    are enough. Rows of one key are ordered by their cells.
    """
    hashed = vectors.filter("key is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256))
    share = 4 * k / max(rows, 1)
    while True:
        below = hashed if share >= 1 else hashed.filter(F.col("hash") < f"{int(share * (1 << 64)):016x}")
        found = below.orderBy("hash", "cells").limit(k).collect()
        if len(found) == k or share >= 1:
            return np.array([row.cells for row in found], np.int64)
        share *= 16


def summed(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: every vector goes to the nearest, and each is the floor of the mean of what it got."""
    shared = vectors.sparkSession.sparkContext.broadcast(Orchard(centroids))
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard, total, counts = shared.value, np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), size).astype(np.int64)
            own = orchard.nearest(x)[0]
            np.add.at(total, own, x)
            counts += np.bincount(own, minlength=k)
        got = np.flatnonzero(counts)
        if len(got):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(got, size)), pa.array(np.tile(np.arange(size), len(got))), pa.array(np.repeat(counts[got], size)), pa.array(total[got].ravel()),
            ], ["cluster", "place", "n", "total"])

    parts = vectors.select("cells").mapInArrow(sums, "cluster long, place long, n long, total long")
    whole = F.col("total").cast("decimal(38,0)")
    parts = parts.groupBy("cluster", "place", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")).agg(F.sum("n").alias("n"), F.sum(whole).alias("total"))
    moved = centroids.copy()
    for row in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        moved[row.cluster, row.place] = int(row.total) // row.n
    return moved


def clusters(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every vector that takes part, written to the shared folder, and the final centroids.

    Vectors that are null, have another number of components, or hold null or non-finite ones take no part. Rows that share a
    key are clustered one by one; a row with a null key is clustered but starts no centroid. With fewer than ``k`` such rows there are fewer
    centroids; with none, no rows come back. Numbers beyond ``BOUND`` count as that.
    """
    scratch = Scratch(rows.sparkSession, "orchard")
    vectors = whole_vectors(rows, key=key, vector=vector, size=size, scale=scale)
    kind = vectors.schema["key"].dataType.simpleString()
    centroids = first_centroids(vectors, rows.count(), k)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], f"key {kind}, cluster int, distance long").withColumnRenamed("key", key), centroids
    for _ in range(rounds):
        centroids = summed(vectors, centroids)
    shared = rows.sparkSession.sparkContext.broadcast(Orchard(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, distance, _ = shared.value.nearest(matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    assigned = scratch.put(vectors.mapInArrow(assign, f"key {kind}, cluster int, distance long"), "assigned")
    return assigned.withColumnRenamed("key", key), centroids


def cluster_digests(rows: DataFrame, **options) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Inertia is the sum of squared distances, over the cluster and over all; a sum that no long holds is the largest long.
    """
    assigned, centroids = clusters(rows, **options)
    spark, parts = rows.sparkSession, F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    sums = assigned.groupBy("cluster", parts).agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    sums = {row.cluster: int(row.total) for row in sums.groupBy("cluster").agg(F.sum("total").alias("total")).collect()}
    whole = min(sum(sums.values()), LARGEST)
    # one row for each centroid
    named = [(number, min(total, LARGEST), whole, hashlib.sha256(",".join(map(str, centroids[number].tolist())).encode()).hexdigest()) for number, total in sums.items()]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    columns = [name for name in assigned.columns if name != "cluster"]
    return assigned.join(F.broadcast(named), "cluster").select(columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
