"""Ranked lists: channels, fusion, reranking, vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import jaccard, words
from colloquy.functions.vectors import cosine_distance


def ranked(rows: DataFrame, by: Sequence[Column], k: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` from 1. Without ``within`` only the first ``k`` rows are numbered, so no sort gathers more."""
    if not within:
        if k is None:
            raise ValueError("a global ranking needs its length")
        rows = rows.orderBy(*by).limit(k)
    order = Window.partitionBy(*within).orderBy(*by) if within else Window.orderBy(*by)
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if within and k is not None else out


def best_per(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The least ``value`` of each ``key``."""
    return rows.groupBy(key).agg(F.min(value).alias(value))


def fuse(channels: DataFrame, rrf_k: int = 60, item: str = "segment_id", within: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of ``(channel, item, rank)``: the sum of 1 / (k + rank) over channels."""
    return channels.groupBy(*within, item).agg(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))).alias("score"), F.count("*").alias("channels"))


def vector_top_k(vectors: DataFrame, query: Column | Sequence[float], k: int, key: str = "segment_id", vec: str = "vec", eligible: DataFrame | None = None) -> DataFrame:
    """``(key, distance, rank)`` of the nearest by cosine; eligibility is applied before the limit."""
    if eligible is not None:
        vectors = vectors.join(eligible, key, "left_semi")
    target = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return ranked(vectors.select(key, cosine_distance(F.col(vec), target).alias("distance")), [F.col("distance"), F.col(key)], k)


def collapse_top_k(hits: DataFrame, links: DataFrame, k: int, over: str = "chunk_id", item: str = "segment_id", value: str = "distance") -> DataFrame:
    """The best hit of each item that a chunk belongs to, then the first ``k`` items: exact, as it collapses before it limits."""
    return ranked(best_per(hits.join(links, over), item, value), [F.col(value), F.col(item)], k)


def rerank(pool: DataFrame, query: Column, text: str = "text", limit: int = 10) -> DataFrame:
    """A pool of ``(rank, text)`` by word overlap with the query; equal scores keep their order."""
    scored = pool.withColumn("rerank_score", jaccard(F.array_distinct(words(query)), F.array_distinct(words(F.col(text)))))
    return ranked(scored.withColumnRenamed("rank", "pool_rank"), [F.col("rerank_score").desc(), F.col("pool_rank")], limit)


def passthrough(pool: DataFrame, rank: str = "rank") -> DataFrame:
    """Scores that keep the order: the last gets 1."""
    return pool.withColumn("rerank_score", (F.count("*").over(Window.partitionBy()) + 1 - F.col(rank)).cast("double"))


def distinct_earliest(matches: DataFrame, k: int, item: str = "segment_id", at: str = "sent_at") -> DataFrame:
    """The earliest match of each item, items with the most recent first."""
    return ranked(matches.groupBy(item).agg(F.min(at).alias("matched_at")), [F.col("matched_at").desc(), F.col(item)], k)


def cap_flag(returned: int, raw: int, k: int, cap: int) -> bool:
    """Whether a scan that stopped at its cap may have starved the result."""
    return returned < k and raw >= cap


def scan_cap(k: int) -> int:
    return max(10 * k, 200)
