"""File sources and sinks that the driver handles: versions, staging, reports, run files."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import shutil
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from colloquy.functions.ids import canonical_json

RUN_FORMAT, SEED_FORMAT = 1, 1


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def cache_path(root: str | Path, sha256: str) -> Path:
    return Path(root) / "attachments" / sha256[:2] / sha256


def store_by_content(source: str | Path, root: str | Path) -> tuple[Path, bool]:
    """Copy a file to the place that its content names; ``(place, whether it was new)``."""
    place = cache_path(root, sha256_file(source))
    if place.is_file():
        return place, False
    place.parent.mkdir(parents=True, exist_ok=True)
    part = place.with_suffix(f".part-{os.getpid()}")
    shutil.copyfile(source, part)
    os.replace(part, place)
    return place, True


def check_snapshot(path: str | Path, tables: Iterable[str]) -> None:
    """An error unless a database file is sound and has the tables that are read later."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        try:
            told = [r[0] for r in db.execute("PRAGMA quick_check")]
            there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        except sqlite3.DatabaseError as error:
            raise ValueError(f"{path} is no sound database: {error}") from error
    if told != ["ok"]:
        raise ValueError(f"{path} is damaged: {told[:3]}")
    if missing := sorted(set(tables) - there):
        raise ValueError(f"{path} lacks the tables {missing}")


def backup(source: str | Path, target: str | Path, pages: int = 1000) -> None:
    """Copy a database that may be in use, page by page and read-only, to a file that appears only when it is whole."""
    import sqlite3

    part = Path(f"{target}.part-{os.getpid()}")
    try:
        with sqlite3.connect(f"file:{source}?mode=ro", uri=True) as live, sqlite3.connect(part) as copy:
            live.backup(copy, pages=pages)
        os.replace(part, target)
    finally:
        part.unlink(missing_ok=True)


def snapshot(source: str | Path, folder: str | Path, keep: int = 2) -> tuple[Path, bool]:
    """A version of a file named by its content; an unchanged file makes none, and all but ``keep`` older ones go."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    versions = sorted(folder.glob("*.snapshot"))
    digest = sha256_file(source)
    if versions and versions[-1].stem.partition("-")[2] == digest:
        return versions[-1], False
    number = int(versions[-1].stem.partition("-")[0]) + 1 if versions else 0
    new = folder / f"{number:08d}-{digest}.snapshot"
    shutil.copyfile(source, new)
    for old in versions[: max(0, len(versions) - keep)]:
        old.unlink()
    return new, True


def swap_pointer(folder: str | Path, version: str) -> None:
    """Make a version the current one, at once."""
    part = Path(folder) / f".current-{os.getpid()}"
    part.write_text(version)
    os.replace(part, Path(folder) / "current")


def stage_documents(folder: str | Path, documents: dict[str, str], manifest: dict[str, Any]) -> Path:
    """Write documents, their metadata lines and the manifest into a folder that must not exist yet."""
    folder = Path(folder)
    (folder / "docs").mkdir(parents=True, exist_ok=False)
    for name, text in documents.items():
        (folder / "docs" / f"{name}.txt").write_text(text, encoding="utf-8")
    rows = [canonical_json({"id": n, "sha256": hashlib.sha256(t.encode()).hexdigest()}) for n, t in sorted(documents.items())]
    (folder / "metadata.jsonl").write_text("".join(r + "\n" for r in rows))
    (folder / "manifest.json").write_text(canonical_json(manifest))
    return folder


def verify_staged(folder: str | Path) -> list[str]:
    """Ids whose staged bytes are not those of the metadata: anything here forbids a push."""
    folder = Path(folder)
    wrong = []
    for line in (folder / "metadata.jsonl").read_text().splitlines():
        row = json.loads(line)
        path = folder / "docs" / f"{row['id']}.txt"
        if not path.is_file() or sha256_file(path) != row["sha256"]:
            wrong.append(row["id"])
    return wrong


def verified_frame(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, verified)`` of every staged document, hashed where it is stored: what an approval is pinned to."""
    from pyspark.sql import functions as F

    told = spark.read.schema("id string, sha256 string").json(f"{folder}/metadata.jsonl")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{folder}/docs")
    hashed = there.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("id"), F.sha2("content", 256).alias("_now"))
    return told.join(hashed, "id", "full_outer").select("id", F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False)).alias("verified"))


def write_run(path: str | Path, run: dict[str, Any]) -> None:
    Path(path).write_text(json.dumps({"format": RUN_FORMAT, **run}, sort_keys=True, indent=1))


def read_run(path: str | Path) -> dict[str, Any]:
    run = json.loads(Path(path).read_text())
    if run.pop("format", None) != RUN_FORMAT:
        raise ValueError("another format of run file")
    return run


def seed_to_json(guids: Iterable[str], **facts: Any) -> str:
    return canonical_json({"format": SEED_FORMAT, "guids": sorted(set(guids)), **facts})


def seed_from_json(text: str) -> dict[str, Any]:
    seed = json.loads(text)
    if seed.pop("format", None) != SEED_FORMAT:
        raise ValueError("another format of seed")
    return seed


def report_csv(sections: dict[str, tuple[list[str], list[list[Any]]]]) -> str:
    """Sections one after the other, each with a title line and a header."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for i, (title, (names, rows)) in enumerate(sections.items()):
        if i:
            writer.writerow([])
        writer.writerow([f"# {title}"])
        writer.writerow(names)
        writer.writerows(rows)
    return out.getvalue()


def text_report(title: str, facts: dict[str, Any], lists: dict[str, Iterable[Any]] | None = None) -> str:
    lines = [title, "=" * len(title), *(f"{k}: {v}" for k, v in facts.items())]
    for name, members in (lists or {}).items():
        lines += ["", name, *(f"  - {m}" for m in members)]
    return "\n".join(lines) + "\n"


# evaluation sets as a small, strict subset of YAML


def rows_to_yaml(rows: Iterable[dict[str, Any]]) -> str:
    """A list of flat mappings; every value is written as JSON, which YAML reads."""
    return "".join("".join(f"{'- ' if i == 0 else '  '}{k}: {json.dumps(v, ensure_ascii=False)}\n" for i, (k, v) in enumerate(row.items())) for row in rows)


def rows_from_yaml(text: str) -> list[dict[str, Any]]:
    rows: list[dict[str, Any]] = []
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, colon, value = line[2:].partition(":")
        if line[:2] not in ("- ", "  ") or not colon or (line[:2] == "  " and not rows):
            raise ValueError(f"line {number}: not a list of flat mappings")
        if line[:2] == "- ":
            rows.append({})
        rows[-1][name.strip()] = json.loads(value) if value.strip()[:1] in '"[{-0123456789tfn' else value.strip()
    return rows


class MemoryTransport:
    """An export target that only remembers: upload, import, delete, absent."""

    def __init__(self) -> None:
        self.objects: dict[str, bytes] = {}
        self.documents: dict[str, str] = {}

    def upload(self, name: str, data: bytes) -> None:
        self.objects[name] = data

    def import_documents(self, documents: dict[str, str]) -> list[str]:
        self.documents |= documents
        return sorted(documents)

    def delete(self, document_id: str) -> None:
        self.documents.pop(document_id, None)
        self.objects.pop(f"segments/{document_id}.txt", None)

    def is_absent(self, document_id: str) -> bool:
        return document_id not in self.documents
