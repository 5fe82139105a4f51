"""Rendering of messages, segments and export documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import mime_kind, snippet

WITHHELD = "[attachment not exported]"


def attachment_text(mime: Column, name: Column, key: Column, pdf_text: Column, caption: Column, ocr: Column, transcript: Column, chars: int, export: bool = False, eligible: Column | None = None) -> Column:
    """An attachment in brackets; in an export one that may not leave is a fixed placeholder."""
    quoted = lambda c: F.concat(F.lit('"'), snippet(c, chars), F.lit('"'))
    kind = mime_kind(mime)
    pdf = F.concat(F.lit('[pdf "'), F.coalesce(F.nullif(name, F.lit("")), F.lit("attachment.pdf")), F.lit('": '), quoted(pdf_text), *([] if export else [F.lit(' — full text via get_attachment_text("'), key, F.lit('")')]), F.lit("]"))
    image = F.concat(F.lit("[image: caption "), quoted(caption), F.lit(" | ocr "), quoted(ocr), F.lit("]"))
    audio = F.concat(F.lit("[audio: transcript "), quoted(transcript), F.lit("]"))
    video = F.concat(F.lit("[video: caption "), quoted(caption), F.lit(" | ocr "), quoted(ocr), F.lit(" | transcript "), quoted(transcript), F.lit("]"))
    other = F.concat(F.lit('[attachment "'), F.coalesce(F.nullif(name, F.lit("")), F.lit("attachment") if export else key), F.lit('"]'))
    out = F.when(kind == "pdf", pdf).when(kind == "image", image).when(kind == "audio", audio).when(kind == "video", video).otherwise(other)
    return out if eligible is None else F.when(F.coalesce(eligible, F.lit(False)), out).otherwise(WITHHELD)


def message_line(at: Column, sender: Column, text: Column, attachments: Column, history: Column | None, reactions: Column, timezone: str = "UTC", full_date: bool = False) -> Column:
    """``[time] sender: text attachments [edited from: ...] reactions``; arrays may be empty."""
    local = F.from_utc_timestamp(at.cast("timestamp"), timezone)
    none = F.array().cast("array<string>")
    parts = [F.when(text != "", F.array(text)).otherwise(none), F.coalesce(attachments, none)]
    if history is not None:
        told = F.concat(F.lit("[edited from: "), F.array_join(F.transform(history, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), " -> "), F.lit("]"))
        parts.append(F.when(F.size(history) > 0, F.array(told)).otherwise(none))
    parts.append(F.coalesce(reactions, none))
    stamp = F.date_format(local, "yyyy-MM-dd HH:mm" if full_date else "HH:mm")
    return F.concat(F.lit("["), stamp, F.lit("] "), sender, F.lit(": "), F.array_join(F.concat(*parts), " "))


def header(people: Column, kind: Column, name: Column, started: Column, ended: Column, timezone: str = "UTC", export: bool = False) -> Column:
    """Two lines: who, and from when to when."""
    start, end = (F.from_utc_timestamp(c.cast("timestamp"), timezone) for c in (started, ended))
    title = F.when(kind == "group", F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(' (group "'), name, F.lit('")'))).otherwise(" (group)")).otherwise("")
    who = F.concat(F.lit("Chat: "), F.array_join(people, ", "), title)
    if export:
        when = F.concat(F.lit("Time: "), F.date_format(start, "yyyy-MM-dd'T'HH:mm"), F.lit(" – "), F.date_format(end, "yyyy-MM-dd'T'HH:mm"), F.lit(f" {timezone}"))
    else:
        last = F.when(F.to_date(start) == F.to_date(end), F.date_format(end, "HH:mm")).otherwise(F.date_format(end, "yyyy-MM-dd HH:mm"))
        when = F.concat(F.lit("Time: "), F.date_format(start, "yyyy-MM-dd HH:mm"), F.lit(" – "), last, F.lit(f" {timezone}"))
    return F.concat_ws("\n", who, when)


def render_segments(lines: DataFrame, heads: DataFrame, segment: str = "segment_id", at: str = "sent_at", tie: str = "message_id", export: bool = False) -> DataFrame:
    """``(segment, rendered_text, rendered_sha256)`` from rows ``(segment, at, tie, line)`` and ``(segment, head)``.

    A segment's messages are bounded by the caps of segmentation.
    """
    body = lines.groupBy(segment).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, tie, "line"))), lambda x: x["line"]), "\n").alias("body"))
    text = F.concat(F.concat_ws("\n", "head", F.lit("---"), "body"), F.lit("\n" if export else ""))
    return heads.join(body, segment).select(segment, text.alias("rendered_text"), F.sha2(text, 256).alias("rendered_sha256"))


def chunk_document(kind: Column, seq: Column, head: Column, text: Column) -> Column:
    """An attachment's chunk as a document of its own."""
    return F.concat(F.lit("Attachment content ("), kind, F.lit(", part "), seq.cast("string"), F.lit(")\n"), head, F.lit("\n---\n"), text, F.lit("\n"))


def sample_lines(document: Column) -> Column:
    """First, middle and last line of a document's body."""
    at = F.instr(document, "\n---\n")
    body = F.filter(F.split(F.when(at > 0, F.substring(document, at + 5, 1 << 30)), "\n"), lambda x: F.trim(x) != "")
    n = F.size(body)
    spots = F.array_distinct(F.array(F.lit(1), F.floor(n / 2).cast("int") + 1, n))
    return F.when(n > 0, F.transform(spots, lambda i: F.element_at(body, i.cast("int")))).otherwise(F.array().cast("array<string>"))
