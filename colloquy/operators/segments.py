"""Segments as readers see them: summaries, threads, and renderings made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.times import lenient_iso
from colloquy.operators import rendering


def segment_summaries(segments: DataFrame, members: DataFrame, people: DataFrame, segment: str = "segment_id", person: str = "person_id", name: str = "short_name") -> DataFrame:
    """Each segment with ``has_attachments`` and the sorted names of its people, each once.

    ``members`` has a row for each message: segment, person, has_attachments.
    """
    told = members.join(people.select(person, name), person, "left").groupBy(segment).agg(F.coalesce(F.some("has_attachments"), F.lit(False)).alias("has_attachments"), F.sort_array(F.collect_set(name)).alias("people"))
    return segments.join(told, segment, "left").withColumns({"has_attachments": F.coalesce("has_attachments", F.lit(False)), "people": F.coalesce("people", F.array().cast("array<string>"))})


def resolve_anchors(requests: DataFrame, segments: DataFrame, chats: DataFrame, messages: DataFrame) -> DataFrame:
    """``(request_id, chat_id, thread_key, anchor_at, error)``: where conversations asked for are to be opened.

    A request's ``thread_id`` is a segment's key or a chat's; its ``anchor`` a
    time in ISO form, the key of a message of that chat, or null, which stands
    for the start of the segment, or of the chat's latest one. Errors are
    ``not_found``, ``no_segments`` and ``bad_anchor``.
    """
    # What a chat adds is joined to segments and chats, so that requests are dealt twice only: by what they ask for, and by their anchors.
    latest = segments.groupBy("chat_id").agg(F.max("started_at").alias("_latest"))
    room = F.struct("chat_id", "thread_key", "_latest")

    def of_chat(rows: DataFrame) -> DataFrame:
        return rows.join(latest, "chat_id", "left").join(chats.select("chat_id", "thread_key"), "chat_id", "left")

    keyed = of_chat(segments.select(F.col("stable_key").alias("thread_id"), "chat_id", "started_at")).select("thread_id", F.col("started_at").alias("_start"), room.alias("_by_segment"))
    named = of_chat(chats.select(F.col("thread_key").alias("thread_id"), "chat_id")).select("thread_id", room.alias("_by_chat"))
    found = requests.join(keyed, "thread_id", "left").join(named, "thread_id", "left").withColumn("_room", F.coalesce("_by_segment", "_by_chat"))
    found = found.select("request_id", "anchor", "_start", *[F.col(f"_room.{c}").alias(c) for c in ("chat_id", "thread_key", "_latest")])
    sent = messages.select("chat_id", F.col("message_key").alias("anchor"), F.col("sent_at").alias("_sent"))
    told = found.join(sent, ["chat_id", "anchor"], "left")
    kind = segments.schema["started_at"].dataType
    at = F.when(F.col("anchor").isNull(), F.coalesce("_start", "_latest")).otherwise(F.coalesce(lenient_iso(F.col("anchor")).cast(kind), F.col("_sent")))
    error = F.when(F.col("chat_id").isNull(), "not_found").when(at.isNull() & F.col("anchor").isNull(), "no_segments").when(at.isNull(), "bad_anchor")
    return told.select("request_id", "chat_id", "thread_key", F.when(error.isNull(), at).alias("anchor_at"), error.alias("error"))


def segments_of_attachments(attachments: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """``(segment_id)`` of every segment with a message that holds one of the attachments."""
    return attachments.select("attachment_id").join(links, "attachment_id").join(members, "message_id").select("segment_id").distinct()


def rerender(segments: DataFrame, affected: DataFrame, lines: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(segments, events)`` after the affected segments were rendered again.

    Membership, keys and all other columns stay. An event is made only for a
    segment whose text came out otherwise; a segment that lost all its messages
    keeps what it has.
    """
    some = affected.select("segment_id").distinct()
    new = rendering.render_segments(lines.join(some, "segment_id", "left_semi"), heads.join(some, "segment_id", "left_semi"))
    new = new.select("segment_id", F.col("rendered_text").alias("_text"), F.col("rendered_sha256").alias("_hash"))
    both = segments.join(new, "segment_id", "left")
    put = {"rendered_text": F.coalesce("_text", "rendered_text"), "rendered_sha256": F.coalesce("_hash", "rendered_sha256")}
    after = both.select(*[put[c].alias(c) if c in put else F.col(c) for c in segments.columns])
    events = both.where(F.col("_hash").isNotNull() & ~F.col("_hash").eqNullSafe(F.col("rendered_sha256"))).select(F.lit("segment").alias("entity_kind"), F.col("segment_id").alias("entity_id"), F.lit("upsert").alias("operation"), F.col("_hash").alias("content_sha256"))
    return after, events
