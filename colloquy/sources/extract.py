"""Attachment files through outside programs, within limits.

Programs are named by the caller, a command for each kind of media, as none of
them is a part of this package. What they print is the text.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import map_batches

#: What a file begins with, for those kinds whose name or type may be wrong.
SIGNATURES = ((b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"RIFF", "audio/wav"), (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"))
RESULT = "attachment_id long, kind string, outcome string, text string, error string"
Command = Callable[[str], Sequence[str]]


@dataclass(frozen=True)
class Limits:
    """Ceilings of one task; beyond them it fails for good."""

    file_bytes: int = 100 << 20
    seconds: float = 120.0
    output_bytes: int = 64 << 20
    pages: int = 2000


class Refused(Exception):
    """A failure that another try would not mend."""


def sniff(data: bytes, stated: str | None) -> str:
    """The media type that a file's first bytes show, else the stated one."""
    if data[4:8] == b"ftyp":
        return stated if stated and stated.startswith(("video/", "audio/")) else "video/mp4"
    return next((kind for start, kind in SIGNATURES if data.startswith(start)), stated or "application/octet-stream")


def run_bounded(command: Sequence[str], limits: Limits) -> str:
    """What a program prints; ``Refused`` if it is absent or prints too much, ``TimeoutError`` if it takes too long."""
    with tempfile.TemporaryFile() as out:
        try:
            done = subprocess.run(list(command), stdout=out, stderr=subprocess.PIPE, timeout=limits.seconds, check=False)
        except FileNotFoundError as error:
            raise Refused(f"no program {command[0]}") from error
        except subprocess.TimeoutExpired as error:
            raise TimeoutError(f"{command[0]} took over {limits.seconds} s") from error
        if out.tell() > limits.output_bytes:
            raise Refused("too much output")
        out.seek(0)
        if done.returncode:
            raise OSError(f"{command[0]}: {done.stderr[-200:].decode('utf-8', 'replace')}")
        return out.read().decode("utf-8", "replace")


def pages_of(text: str) -> list[str]:
    """Pages parted by form feeds, as extractors of page texts print them."""
    pages = text.split("\f")
    return pages[:-1] if pages and not pages[-1].strip() else pages


def is_scanned(pages: Sequence[str], least_per_page: float = 50.0) -> bool:
    """Whether there is so little text on a page that it must be in pictures; also of no page."""
    return not pages or sum(len(p.strip()) for p in pages) / len(pages) < least_per_page


def extract_one(path: str, kind: str, commands: dict[str, Command], limits: Limits) -> tuple[str, str | None, str | None]:
    """``(outcome, text, error)`` of one task: done, skipped (nothing to read), retry or failed."""
    try:
        if os.path.getsize(path) > limits.file_bytes:
            raise Refused("too many bytes")
        if kind not in commands:
            raise Refused(f"no program for {kind}")
        text = run_bounded(commands[kind](path), limits)
        if kind == "pdf_text" and len(pages_of(text)) > limits.pages:
            raise Refused("too many pages")
        return ("done" if text.strip() else "skipped"), text, None
    except Refused as error:
        return "failed", None, str(error)
    except (OSError, TimeoutError) as error:
        return "retry", None, str(error)


def extract(tasks: DataFrame, commands: dict[str, Command], limits: Limits | None = None, path: str = "path") -> DataFrame:
    """``(attachment_id, kind, outcome, text, error)`` of tasks ``(attachment_id, kind, path)``; paths are those that executors see."""
    bounds = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, k, p in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                told = extract_one(p, k, commands, bounds)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), *(pa.array([x], pa.string()) for x in (k, *told))], ["attachment_id", "kind", "outcome", "text", "error"])

    return map_batches(tasks.select("attachment_id", "kind", path), run, RESULT)


def follow_ups(results: DataFrame, least_per_page: float = 50.0) -> DataFrame:
    """``(attachment_id, kind)`` of further tasks: documents whose pages hold hardly any text are to be read as pictures."""
    pages = F.filter(F.split(F.coalesce("text", F.lit("")), "\f"), lambda p: F.trim(p) != "")
    shown = F.aggregate(pages, F.lit(0), lambda n, p: n + F.length(F.trim(p)))
    total = F.greatest(F.size(F.split(F.coalesce("text", F.lit("")), "\f")) - 1, F.lit(1))
    return results.where((F.col("kind") == "pdf_text") & F.col("outcome").isin("done", "skipped") & (shown / total < least_per_page)).select("attachment_id", F.lit("ocr").alias("kind"))


def dataless(size: Column, blocks: Column, flags: Column | None = None) -> Column:
    """Whether a file is a placeholder: it has a size but no blocks, or a flag says so; unknown counts as not."""
    empty = F.coalesce((blocks == 0) & (size > 0), F.lit(False))
    return empty if flags is None else empty | F.coalesce(F.array_contains(F.split(flags, ","), "dataless"), F.lit(False))
