"""Pruned vector search gives the rows of a scan, and reads fewer files."""

import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import nearest, ranking


def test_same_as_a_scan(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.05 * rng.normal(size=(30, 8)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [0.0] * 8), (1001, None), (1002, x[0].tolist())]
    vectors = spark.createDataFrame(rows, "segment_id long, vec array<double>")
    index = nearest.write_vectors(vectors, str(tmp_path / "v"), clusters=12)
    assert index.rows.count() == len(rows)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    for q, k in ((x[3], 5), (x[100] + 0.3, 10), (rng.normal(size=8), 40), (x[7], 400)):
        query = q.tolist()
        want = [tuple(r) for r in ranking.vector_top_k(vectors, query, k).orderBy("rank").collect()]
        assert [tuple(r) for r in index.top_k(query, k).orderBy("rank").collect()] == want
    needed = index.needed(x[3].tolist(), 5)
    assert len(needed) <= 3 and files(index.of_clusters(needed)) < files(index.rows) / 2
    assert "PartitionFilters: [cluster" in index.of_clusters(needed)._jdf.queryExecution().toString()
    odd = vectors.where("segment_id % 2 = 1").select("segment_id")
    want = [tuple(r) for r in ranking.vector_top_k(vectors, x[3].tolist(), 20, eligible=odd).orderBy("rank").collect()]
    assert [tuple(r) for r in index.top_k(x[3].tolist(), 20, odd).orderBy("rank").collect()] == want
    # No bound is above a distance.
    q = rng.normal(size=8)
    bounds = dict(zip(index.names.tolist(), index.bounds(q.tolist()), strict=True))
    told = index.rows.where("cluster >= 0").select("cluster", nearest.cosine_distance(F.col("vec"), F.array(*map(F.lit, q.tolist()))).alias("d")).groupBy("cluster").agg(F.min("d").alias("d")).collect()
    assert all(bounds[r["cluster"]] <= r["d"] for r in told)


def test_nothing_to_search(spark, tmp_path):
    none = spark.createDataFrame([], "segment_id long, vec array<double>")
    assert nearest.write_vectors(none, str(tmp_path / "v")).top_k([1.0, 0.0], 5).count() == 0
