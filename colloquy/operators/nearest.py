"""Nearest vectors without a scan: clusters with radii, and exact pruning.

Vectors are kept by their nearest centre, in a folder for each cluster. Of a
cluster the centre, the number of its members and the greatest angle between the
centre and a member are known. Angles on the unit sphere obey the triangle
inequality, so no member is nearer to a query than the centre's angle less that
radius. A search reads clusters in the order of this bound and stops when the
k-th distance found is below the bound of the next: what it has not read cannot
be among the first k. Where vectors have no clusters it reads all of them, and is
then as exact as a scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.vectors import cosine_distance
from colloquy.operators.ranking import vector_top_k
from colloquy.session import map_batches

#: Vectors that centres are fitted on, and clusters, at most: both are held by the driver.
SAMPLE, CLUSTERS_MOST = 16_384, 4096
#: Angles are told too small by this, so that rounding never prunes.
SLACK = 1e-6
#: The cluster of vectors without an angle: null, zero, not finite, or of another dimension. It is always read.
ODD = -1


def _units(vectors: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one dimension at length one, and which have one."""
    x = np.array(vectors, dtype=np.float64)
    length = np.linalg.norm(x, axis=1)
    good = np.isfinite(length) & (length > 0)
    x[~good] = 0
    return x / np.where(good, length, 1)[:, None], good


def _centres(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """Clustered vectors ``(key, vec, cluster)`` in a folder, and what the driver knows of the clusters."""

    spark: SparkSession
    path: str
    key: str
    vec: str
    schema: str
    names: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, cluster int").parquet(self.path)

    def of_clusters(self, names: Sequence[int]) -> DataFrame:
        """The vectors of some clusters, of which alone the files are read."""
        return self.rows.where(F.col("cluster").isin([ODD, *map(int, names)]))

    def bounds(self, query: Sequence[float]) -> np.ndarray:
        """What no member of each cluster is nearer than, as a cosine distance."""
        q, good = _units([query])
        if not len(self.names) or not good[0] or q.shape[1] != self.centres.shape[1]:
            return np.zeros(len(self.names))
        angle = np.arccos(np.clip(self.centres @ q[0], -1, 1)) - self.radii - SLACK
        return 1 - np.cos(np.maximum(angle, 0))

    def needed(self, query: Sequence[float], k: int, eligible: DataFrame | None = None) -> list[int]:
        """The clusters that can hold one of the ``k`` nearest: read in the order of their bounds, twice as many in each round."""
        bounds = self.bounds(query)
        order = np.argsort(bounds, kind="stable")
        read, step, best = 0, max(1, len(order) // 16), []
        while True:
            names = self.names[order[read : read + step]]
            part = self.of_clusters(names) if read == 0 else self.rows.where(F.col("cluster").isin([int(n) for n in names]))
            if eligible is not None:
                part = part.join(eligible, self.key, "left_semi")
            distance = cosine_distance(F.col(self.vec), F.array(*[F.lit(float(x)) for x in query]))
            best = sorted([*best, *(r[0] for r in part.select(distance.alias("d")).where("d is not null").orderBy("d").limit(k).collect())])[:k]  # k numbers
            read += len(names)
            if read >= len(order) or len(best) == k and best[-1] < bounds[order[read]] - 1e-9:
                return [int(n) for n in self.names[order[:read]]]
            step *= 2

    def top_k(self, query: Sequence[float], k: int, eligible: DataFrame | None = None) -> DataFrame:
        """``(key, distance, rank)`` of the nearest, as ``ranking.vector_top_k`` of all vectors; vectors without an angle come first where that puts nulls."""
        return vector_top_k(self.of_clusters(self.needed(query, k, eligible)).select(self.key, self.vec), query, k, self.key, self.vec, eligible)


def write_vectors(vectors: DataFrame, folder: str, clusters: int | None = None, key: str = "segment_id", vec: str = "vec") -> VectorIndex:
    """Cluster and write vectors. Centres are fitted on ``SAMPLE`` of them at most, drawn by a hash; all are assigned and told in the radii."""
    spark = vectors.sparkSession
    rows = vectors.select(key, F.col(vec).cast("array<double>").alias(vec))
    fields = rows.schema
    name = f"{key} {fields[key].dataType.simpleString()}"
    sample = rows.where(F.size(vec) > 0).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vec).collect()
    size = max(map(len, (r[0] for r in sample)), default=0)
    usable = [r[0] for r in sample if len(r[0]) == size and None not in r[0]]
    x, good = _units(usable) if usable else (np.zeros((0, size)), np.zeros(0, bool))
    x = x[good]
    k = min(len(x), CLUSTERS_MOST, clusters or max(1, int(np.sqrt(vectors.count()))))
    centres = _centres(x, k) if k else np.zeros((0, size))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            cluster, angle = np.full(len(given), ODD, dtype=np.int32), np.zeros(len(given))
            fit = [i for i, v in enumerate(given) if v is not None and len(v) == size and None not in v] if k else []
            if fit:
                u, ok = _units([given[i] for i in fit])
                cosine = u @ centres.T
                best = cosine.argmax(axis=1)
                at = np.array(fit)[ok]
                cluster[at] = best[ok]
                angle[at] = np.arccos(np.clip(cosine[np.arange(len(fit)), best][ok], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle)], [key, vec, "cluster", "angle"])

    path = f"{folder}/{uuid.uuid4().hex}"
    map_batches(rows, assign, f"{name}, {vec} array<double>, cluster int, angle double").repartition("cluster").write.partitionBy("cluster").parquet(path)
    schema = f"{name}, {vec} array<double>"
    told = spark.read.schema(f"{schema}, angle double, cluster int").parquet(path).where(F.col("cluster") != ODD).groupBy("cluster").agg(F.max("angle").alias("radius")).orderBy("cluster").collect()  # a row for each cluster
    names = np.array([r["cluster"] for r in told], dtype=np.int64)
    return VectorIndex(spark, path, key, vec, schema, names, centres[names] if len(names) else centres, np.array([r["radius"] for r in told]))
