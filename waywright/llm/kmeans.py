"""Centroid clustering in whole numbers: float32 products screen, exact arithmetic decides.

A product of float32 vectors is wrong by less than a bound that is known beforehand.  Every
centroid's squared distance therefore lies in an interval around what the fast matrix product
gives; a centroid whose interval lies above another's is out.  Where intervals overlap, the
distances are computed anew in 64-bit integers, and the smallest number wins a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .topk import usable

#: Whole components up to this magnitude: distances of up to MOST_DIM components then fit 64 bits, and float32 products don't overflow.
MOST_UNIT, MOST_DIM = 1 << 27, 64
#: Vectors that are multiplied at a time.
TILE = 8_192
UNIT = 2.0**-24
ASSIGNED = "cluster int, distance long"


def quantize(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and units: floor(scale * x) of each component of the vectors with ``dim`` components, none null or non-finite.

    Components beyond MOST_UNIT can't be told apart in 64 bits; vectors that hold one get null units.
    """
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    fits = F.forall(F.col("embedding").cast("array<double>"), lambda x: F.abs(x) <= F.lit(MOST_UNIT / scale))
    kept = vectors.filter((F.size("embedding") == dim) & usable("embedding"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fits, whole.cast("array<int>")).alias("units"))


def first_centroids(quantized: DataFrame, k: int, seed: int) -> np.ndarray:
    """The units of the k vectors whose ids have the smallest hashes; ids that repeat go by their units, rows without an id come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = quantized.filter("units is not null").select(key.alias("key"), "units").orderBy(F.col("key").asc_nulls_last(), "units").limit(k).collect()
    return np.array([r.units for r in rows], np.int64)


class Assigner:
    """Nearest centroids of whole-number vectors, exactly."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids
        self.fast = np.ascontiguousarray(centroids.T, np.float32)
        self.square = (centroids * centroids).sum(axis=1)
        terms = centroids.shape[1] + 2  # a product's terms, and the rounding of either factor to float32
        self.share = terms * UNIT / (1 - terms * UNIT)
        self.norm = np.sqrt(self.square.astype(float)) * (1 + 1e-12)

    def screen(self, units: np.ndarray) -> np.ndarray:
        """True for each centroid (column) that rounding doesn't let us rule out for a vector (row).

        By the bound on inner products, |computed - true| <= share * sum |x||c|, which is at most
        share * |x| * |c|.  The vector's own square is common to all distances and left out.
        """
        about = self.square - 2.0 * (units.astype(np.float32) @ self.fast).astype(float)
        norm = np.sqrt(np.einsum("ij,ij->i", units, units).astype(float)) * (1 + 1e-12)
        slack = 2 * self.share * norm[:, None] * self.norm + np.abs(about) * 1e-15 + self.square * 1e-15
        return about - slack <= (about + slack).min(axis=1)[:, None]

    def __call__(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and squared distance."""
        near = self.screen(units)
        found = near.argmax(axis=1)
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            among = np.flatnonzero(near[i])
            found[i] = among[(self.square[among] - 2 * (self.exact[among] @ units[i])).argmin()]
        apart = units - self.exact[found]
        return found, np.einsum("ij,ij->i", apart, apart)


def _tiles(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their units (column 1), as 64-bit numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            yield part, part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _summing(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counts and sums, one row a centroid and component."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, n, total = Assigner(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, units in _tiles(batches, dim):
            found, _ = assign(units)
            n += np.bincount(found, minlength=k)
            for j in range(k):
                total[j] += units[found == j].sum(axis=0)
        rows = [np.repeat(np.arange(k), dim), np.tile(np.arange(dim), k), np.repeat(n, dim), total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], names=["cluster", "component", "n", "total"])

    return run


def moved(quantized: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; those without vectors stay.

    What the driver reads is one row a centroid and component, whatever the number of vectors.
    """
    sums = quantized.mapInArrow(_summing(centroids), "cluster long, component long, n long, total long").groupBy("cluster", "component")
    out = centroids.copy()
    for r in sums.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).filter("n > 0").collect():
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def _assigning(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(centroids)
        for part, units in _tiles(batches, centroids.shape[1]):
            found, distance = assign(units)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Lloyd's rounds over every vector with ``dim`` finite components, in whole numbers.

    Returns vec_id, cluster, distance (squared), cluster_inertia and inertia (distances added
    up over the cluster and over all) and centroid_sha256 (of the final centroid's components,
    joined by commas).  Fewer vectors than ``k`` give as many centroids; no vectors, no rows.

    Vectors that are null, of another length, or hold null or non-finite components take no
    part.  Repeated rows are vectors of their own, those without an id too, which are never
    first centroids while others are left.  Ties go to the smallest centroid number.  A vector
    with a component beyond MOST_UNIT after scaling has no 64-bit distance: its row has nulls
    and moves no centroid.  Other columns, whatever their names, are ignored.
    """
    if not 0 < dim <= MOST_DIM:
        raise ValueError(f"vectors of 1 to {MOST_DIM} components are supported")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kmeans")
    every = scratch.cut(quantize(vectors, dim, scale), "units")
    part = every.filter("units is not null")
    centroids = first_centroids(every, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(part, centroids)
    schema = f"vec_id long, {ASSIGNED}"
    if not len(centroids):
        own = every.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    else:
        own = scratch.cut(part.mapInArrow(_assigning(centroids), schema), "assigned")
    inertia = {r.cluster: int(r.total) for r in own.filter("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = sum(inertia.values())
    facts = [(j, str(inertia[j]), str(whole), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sorted(inertia)]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    named = named.select("cluster", *(F.expr(f"try_cast({c} as long)").alias(c) for c in ("cluster_inertia", "inertia")), "centroid_sha256")
    out = own.join(F.broadcast(named), "cluster", "left")  # one row a centroid
    if len(centroids):
        beyond = every.filter("units is null").select("vec_id")
        out = out.unionByName(beyond, allowMissingColumns=True)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
