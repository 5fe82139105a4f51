"""Keys and hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def derived_key(kind: str, guid: Column) -> Column:
    """An opaque key of a message, thread or attachment; an empty guid is an error."""
    return F.when(F.coalesce(guid, F.lit("")) == "", F.raise_error(F.lit(f"{kind}: empty source guid"))).otherwise(F.sha2(F.concat(F.lit(kind + ":"), guid), 256))


def stable_key(chat_guid: Column, first_guid: Column, last_guid: Column, config_hash: str | Column) -> Column:
    """Key of a segment: what it is of, from where to where, under which configuration."""
    config = F.lit(config_hash) if isinstance(config_hash, str) else config_hash
    return F.sha2(F.concat(chat_guid, first_guid, last_guid, config), 256)


def _document_id(payload: Column) -> Column:
    return F.concat(F.lit("d"), F.substring(F.sha2(payload, 256), 1, 62))


def segment_document_id(key: Column) -> Column:
    return _document_id(F.concat(F.lit("segment:"), key))


def chunk_document_id(key: Column, attachment_guid: Column, kind: Column, seq: Column) -> Column:
    return _document_id(F.concat_ws(":", F.lit("attachment_chunk"), key, attachment_guid, kind, seq.cast("string")))


# on the driver


def segmentation_config_hash(*, session_gap_hours: float, topical_min_messages: int, max_messages: int, max_tokens: int, boundary_model: str, boundary_prompt: bytes, index_unsent: bool, index_edit_history: bool, renderer_version: str = "1", window_tokens: int = 4000, window_overlap: int = 10, min_messages: int = 2) -> str:
    """One hash of all that changes segments."""
    # The names and order of what is hashed.
    fields = {
        "session_gap_hours": repr(session_gap_hours), "topical_min_messages": topical_min_messages, "max_messages": max_messages, "max_tokens": max_tokens,
        "boundary_model": boundary_model, "boundary_prompt_sha256": hashlib.sha256(boundary_prompt.decode("utf-8", "replace").encode()).hexdigest(),
        "index_unsent": index_unsent, "index_edit_history": index_edit_history, "renderer_version": renderer_version,
        "boundary_window_tokens": window_tokens, "boundary_window_overlap_messages": window_overlap, "min_messages_per_segment": min_messages,
    }
    return hashlib.sha256(" ".join(["seg_config_hash/v1", *(f"{k}={v}" for k, v in fields.items())]).encode()).hexdigest()


def config_hash(fields: dict[str, Column | str], version: str = "seg_config_hash/v1") -> Column:
    """``segmentation_config_hash`` of columns: the fields in the order given, as ``name=value`` behind the version."""
    parts = [F.concat(F.lit(f"{k}="), (v if isinstance(v, Column) else F.lit(v)).cast("string")) for k, v in fields.items()]
    return F.sha2(F.concat_ws(" ", F.lit(version), *parts), 256)


def projected_hash(config: dict[str, Any], names: Sequence[str]) -> str:
    """Hash of those settings that matter to a result: dotted names that are absent count as null."""
    def at(name: str) -> Any:
        value: Any = config
        for part in name.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        return value

    return canonical_hash({n: at(n) for n in names})


def canonical_json(value: Any, ascii_only: bool = True) -> str:
    """The one JSON form of a value: sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def canonical_hash(value: Any, ascii_only: bool = True) -> str:
    return hashlib.sha256(canonical_json(value, ascii_only).encode()).hexdigest()
