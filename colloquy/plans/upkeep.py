"""Composite jobs: incremental segmentation, export planning, the sync run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import ids
from colloquy.functions.ids import canonical_hash
from colloquy.operators import access, identity, incremental, rendering, sessions


def resegment(messages: DataFrame, existing: DataFrame, changes: DataFrame, gap_hours: float) -> tuple[DataFrame, DataFrame]:
    """``(kept, rebuilt)`` session summaries after changes to some chats.

    Sessions before a chat's frontier are kept, the rest is rebuilt from the
    messages at or after it; together they equal a full rebuild. Session numbers
    of the rebuilt part start anew, as a session is known by its chat and start.
    """
    start = sessions.recompute_start(existing, changes, gap_hours)
    kept = existing.join(start, "chat_id", "left").where(F.col("recompute_from").isNull() | (F.col("started_at") < F.col("recompute_from"))).select(*existing.columns)
    again = messages.join(start, "chat_id").where(F.col("sent_at") >= F.col("recompute_from")).select(*messages.columns)
    return kept, sessions.summarize_sessions(sessions.sessionize(again, gap_hours)).select(*existing.columns)


@dataclass(frozen=True)
class ExportPlan:
    """What a push would do, and whether it needs an approval."""

    actions: DataFrame
    reasons: tuple[str, ...]
    config_sha256: str


def plan_export(documents: DataFrame, eligible: DataFrame, pushed: DataFrame, config: dict, last_config_sha256: str | None, mode: str = "normal") -> ExportPlan:
    """Reconcile the documents of eligible chats with what was pushed.

    ``documents`` and ``pushed`` have document_id, chat_id, person, mime_type and
    content_sha256. A purge only retracts and needs no approval.
    """
    wanted = documents.join(eligible.where("eligible").select("chat_id"), "chat_id", "left_semi")
    actions = access.reconcile(wanted, pushed)
    if mode == "purge":
        actions = actions.where("action <> 'upsert'")
    planned = wanted.join(actions.where("action = 'upsert'"), "document_id", "left_semi")
    digest = canonical_hash(config)
    reasons = access.approval_reasons(
        planned, pushed, {"new_person": "person", "new_thread": "chat_id", "new_mime_type": "mime_type"}, has_deletes=not actions.where("action = 'delete'").isEmpty(),
        config_changed=last_config_sha256 is not None and last_config_sha256 != digest, first_push=last_config_sha256 is None, mode=mode,
    )
    return ExportPlan(actions, tuple(reasons), digest)


def desired_documents(segments: DataFrame, lines: DataFrame, heads: DataFrame, eligible: DataFrame, chunks: DataFrame, gate: DataFrame) -> DataFrame:
    """``(document_id, segment_id, chat_id, kind, text, content_sha256)`` of all documents that should be exported.

    A segment of an eligible chat is a document if any of its messages may be
    told: ``lines`` ``(segment_id, sent_at, message_id, line)`` holds those.
    Every chunk ``(attachment_id, attachment_guid, chunk_kind, seq, text)`` of an
    attachment is one for each such segment that its content may leave with
    (``gate``: segment_id, attachment_id, content_eligible).
    """
    ours = segments.join(eligible.where("eligible").select("chat_id"), "chat_id", "left_semi")
    own = rendering.render_segments(lines.join(ours, "segment_id", "left_semi"), heads, export=True).join(ours.select("segment_id", "chat_id", "stable_key"), "segment_id")
    whole = own.select(ids.segment_document_id(F.col("stable_key")).alias("document_id"), "segment_id", "chat_id", F.lit("segment").alias("kind"), F.col("rendered_text").alias("text"))
    open_ = gate.where("content_eligible").select("segment_id", "attachment_id")
    told = ours.join(lines.select("segment_id"), "segment_id", "left_semi")  # chunks need no rendered text
    parts = told.select("segment_id", "chat_id", "stable_key").join(heads, "segment_id").join(open_, "segment_id").join(chunks, "attachment_id")
    chunk = parts.select(
        ids.chunk_document_id(F.col("stable_key"), F.col("attachment_guid"), F.col("chunk_kind"), F.col("seq")).alias("document_id"), "segment_id", "chat_id", F.lit("chunk").alias("kind"),
        rendering.chunk_document(F.col("chunk_kind"), F.col("seq") + 1, F.col("head"), F.col("text")).alias("text"),
    )
    return whole.unionByName(chunk).withColumn("content_sha256", F.sha2("text", 256))


def purge_plan(allowlist: DataFrame, revoked: DataFrame, chats: DataFrame, participants: DataFrame, documents: DataFrame, pushed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(allowlist, actions)`` of a revocation: flags go, rows stay, and what may no longer be out is deleted."""
    now = access.revoke(allowlist, revoked)
    denied = {"participant_not_allowed": access.not_allowed(participants, now)}
    eligible = access.eligible_chats(chats, participants, denied)
    return now, plan_export(documents, eligible, pushed, {}, None, mode="purge").actions


def drifted(planned: DataFrame, now: DataFrame, key: str = "document_id", content: str = "content_sha256") -> DataFrame:
    """Planned documents whose content, or whose right to leave, has changed since: a push of them must stop."""
    fresh = now.select(key, F.col(content).alias("_now"))
    return planned.join(fresh, key, "left").where(~F.col(content).eqNullSafe(F.col("_now"))).select(key)


def attachment_text(attachments: DataFrame, links: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """The texts of one attachment; one that may not be seen is as absent as one that does not exist."""
    found = attachments.where(F.col("attachment_key") == key)
    return found.join(links.join(visible, "segment_id", "left_semi"), "attachment_id", "left_semi")


def sync(sources: Sequence[str], extract: Callable[[str], None], resolve: Callable[[], DataFrame], rebuild: Callable[[], None], index: Callable[[], None], dry_run: bool = False) -> list[str]:
    """Extract every source, resolve identities, and go on only if the report is clean; returns the steps done.

    A source that fails does not keep the others from being extracted, but
    nothing is built on them. A dry run extracts nothing and only tells the steps.
    """
    steps = [*(f"extract:{s}" for s in sources), "segment", "index"]
    if dry_run:
        return steps
    done, failed = [], {}
    for source in sources:
        try:
            extract(source)
            done.append(f"extract:{source}")
        except Exception as error:
            failed[source] = error
    if failed:
        raise RuntimeError(f"sources failed: {failed}") from next(iter(failed.values()))
    identity.require_clean(resolve())
    for name, step in (("segment", rebuild), ("index", index)):
        step()
        done.append(name)
    return done


def outbox_position(events: DataFrame) -> int:
    """The last event; a rebuild takes it first, so that later events are applied again."""
    return int(events.agg(F.max("event_id")).first()[0] or 0)


def refreshed(index: DataFrame, events: DataFrame, content: DataFrame, position: int) -> DataFrame:
    """The index with all events after a position applied."""
    return incremental.apply_outbox(index, events, content, position)[0]
