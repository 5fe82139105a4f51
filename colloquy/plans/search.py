"""The hybrid search: channels under one predicate, fused, reranked, cut."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import lexical, ranking
from colloquy.operators.access import AccessContext, Filters, check_range, in_dates, visible_segments

MOST_QUERY_CHARS, MOST_RESULTS = 1000, 50


@dataclass(frozen=True)
class SearchTables:
    """What a search reads. Chunks are ``(segment_id, chunk_id, text)``; a table that is absent has no channel.

    With the indexes of segments (key ``segment_id``) and chunks (``chunk_id``)
    no text is cut into terms but those of the reranked pool; quoted phrases use
    the indexes of trigrams, without which texts are scanned and hits counted
    there. ``originals`` ``(segment_id, sent_at, text_original)`` are the
    messages as they were written, in which emoji are looked for.
    """

    segments: DataFrame
    vectors: DataFrame
    chunks: DataFrame | None = None
    chunk_vectors: DataFrame | None = None
    participants: DataFrame | None = None
    allowlist: DataFrame | None = None
    with_attachments: DataFrame | None = None
    text_index: lexical.LexicalIndex | None = None
    chunk_index: lexical.LexicalIndex | None = None
    text_trigrams: lexical.LexicalIndex | None = None
    chunk_trigrams: lexical.LexicalIndex | None = None
    originals: DataFrame | None = None


def hybrid_search(tables: SearchTables, query: str, query_vector: Sequence[float], *, filters: Filters | None = None, context: AccessContext | None = None, limit: int = 10, k: int = 100, rrf_k: int = 60, pool: int = 50) -> DataFrame:
    """``(segment_id, rank, score, rerank_score)`` of the best ``limit`` segments.

    Every channel is restricted by the same predicate before it is limited, so a
    selective filter starves none; a text's score is that in the whole corpus,
    whatever the filter leaves. Each channel contributes ``k`` ranks at most.
    """
    filters, context = filters or Filters(), context or AccessContext()
    if not query.strip() or len(query) > MOST_QUERY_CHARS:
        raise ValueError("the query is empty or too long")
    check_range("limit", limit, 1, MOST_RESULTS)
    if tables.participants is None and not filters.people and context.scope == "full" and filters.has_attachment is None:
        kept = tables.segments.where(in_dates(F.col("started_at"), filters.after, filters.before, filters.timezone))
        for condition in filters.extra:
            kept = kept.where(condition)
        eligible = kept.select("segment_id")
    else:
        eligible = visible_segments(tables.segments, filters, context, participants=tables.participants, allowlist=tables.allowlist, with_attachments=tables.with_attachments)
    routed = lexical.route(query)
    by_id = F.col("segment_id")

    def lexical_channel(docs: DataFrame, name: str, key: str, words: lexical.LexicalIndex | None, trigrams: lexical.LexicalIndex | None) -> DataFrame:
        if routed.mode == "emoji":
            return emoji_channel(docs, name, key)
        if routed.mode == "bm25":
            hits = words.search(routed.phrase) if words is not None else lexical.bm25(docs, routed.phrase, key=key)
        else:
            hits = trigrams.search(routed.phrase) if trigrams is not None else lexical.bm25_of_phrase(docs, routed.phrase, key=key)
        if key != "segment_id":
            hits = hits.join(docs.select(key, "segment_id"), key).groupBy("segment_id").agg(F.max("score").alias("score"))
        hits = hits.join(eligible, "segment_id", "left_semi")
        return ranking.ranked(hits, [F.col("score").desc(), by_id], k).select(F.lit(name).alias("channel"), "segment_id", "rank")

    def emoji_channel(docs: DataFrame, name: str, key: str) -> DataFrame:
        """Segments by the time of their earliest message that has the emoji, the most recent first; those of chunks by their ids."""
        if key == "segment_id" and tables.originals is not None:
            hits = lexical.substring_hits(tables.originals, routed.phrase, "text_original", ignore_case=False).join(eligible, "segment_id", "left_semi")
            found = ranking.distinct_earliest(hits, k)
        else:
            hits = lexical.substring_hits(docs, routed.phrase, ignore_case=False).join(eligible, "segment_id", "left_semi")
            found = ranking.ranked(hits.select("segment_id").distinct(), [by_id], k)
        return found.select(F.lit(name).alias("channel"), "segment_id", "rank")

    channels = [lexical_channel(tables.segments.select("segment_id", "text"), "text", "segment_id", tables.text_index, tables.text_trigrams)]
    channels.append(ranking.vector_top_k(tables.vectors, query_vector, k, eligible=eligible).select(F.lit("vector").alias("channel"), "segment_id", "rank"))
    if tables.chunks is not None:
        channels.append(lexical_channel(tables.chunks.select("segment_id", "chunk_id", "text"), "chunk", "chunk_id", tables.chunk_index, tables.chunk_trigrams))
    if tables.chunk_vectors is not None:
        near = tables.chunk_vectors.join(eligible, "segment_id", "left_semi")
        hits = near.select("segment_id", ranking.cosine_distance(F.col("vec"), F.array(*[F.lit(float(x)) for x in query_vector])).alias("distance"))
        channels.append(ranking.ranked(ranking.best_per(hits, "segment_id", "distance"), [F.col("distance"), by_id], k).select(F.lit("chunk_vector").alias("channel"), "segment_id", "rank"))
    union = channels[0]
    for c in channels[1:]:
        union = union.unionByName(c)
    fused = ranking.ranked(ranking.fuse(union, rrf_k), [F.col("score").desc(), by_id], pool)
    texts = tables.segments.select("segment_id", "text")
    best = ranking.rerank(F.broadcast(fused).join(texts, "segment_id"), F.lit(routed.phrase), limit=limit)  # ``pool`` rows at most
    return best.select("segment_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))
