"""Who and what a query may see: filters, scopes and export eligibility."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.times import local_midnight

MOST_PEOPLE = 20


class InvalidArgument(ValueError):
    """A filter or limit outside what is allowed."""


@dataclass(frozen=True)
class AccessContext:
    """On whose behalf a query runs. The local surface always sees everything."""

    surface: str = "local"
    scope: str = "full"

    def __post_init__(self) -> None:
        if self.surface not in ("local", "public") or self.scope not in ("full", "allowlist"):
            raise InvalidArgument("unknown surface or scope")
        if self.surface == "local" and self.scope != "full":
            raise InvalidArgument("the local surface has the full scope")


@dataclass(frozen=True)
class Filters:
    """What a search is restricted to; ``after`` is inclusive, ``before`` exclusive, both at local midnight."""

    people: tuple[int, ...] = ()
    after: str | None = None
    before: str | None = None
    has_attachment: bool | None = None
    timezone: str = "UTC"
    extra: tuple[Column, ...] = field(default=())

    def __post_init__(self) -> None:
        if len(self.people) > MOST_PEOPLE:
            raise InvalidArgument(f"more than {MOST_PEOPLE} people")
        if self.after and self.before and self.after >= self.before:
            raise InvalidArgument("after must come before before")


def check_range(name: str, value: int, least: int, most: int) -> int:
    if not least <= value <= most:
        raise InvalidArgument(f"{name} must be from {least} to {most}")
    return value


def in_dates(at: Column, after: str | None, before: str | None, timezone: str = "UTC") -> Column:
    at, out = at.cast("timestamp"), F.lit(True)
    if after:
        out = out & (at >= local_midnight(after, timezone))
    if before:
        out = out & (at < local_midnight(before, timezone))
    return out


def with_all_people(participants: DataFrame, people: tuple[int, ...], chat: str = "chat_id", person: str = "person_id") -> DataFrame:
    """Chats in which all of ``people`` take part (relational division)."""
    wanted = sorted(set(people))
    found = participants.where(F.col(person).isin(wanted)).groupBy(chat).agg(F.countDistinct(person).alias("n"))
    return found.where(F.col("n") == len(wanted)).select(chat)


def scoped_chats(chats: DataFrame, participants: DataFrame, allowlist: DataFrame, context: AccessContext, chat: str = "chat_id", person: str = "person_id") -> DataFrame:
    """Chats that a context may read: none of whose participants lacks permission. A chat without participants passes."""
    if context.scope == "full":
        return chats.select(chat)
    outsiders = not_allowed(participants, allowlist, person).select(chat)
    return chats.select(chat).join(outsiders, chat, "left_anti")


def visible_segments(segments: DataFrame, filters: Filters, context: AccessContext, *, participants: DataFrame, allowlist: DataFrame, with_attachments: DataFrame | None = None, chat: str = "chat_id", segment: str = "segment_id", at: str = "started_at") -> DataFrame:
    """The one predicate: ``segment_id`` of every segment that filters and context let through.

    Every search channel is semi-joined with it before anything is limited.
    ``filters.extra`` are conditions on the columns of ``segments``.
    """
    out = segments.where(in_dates(F.col(at), filters.after, filters.before, filters.timezone))
    for condition in filters.extra:
        out = out.where(condition)
    if filters.people:
        out = out.join(with_all_people(participants, filters.people, chat), chat, "left_semi")
    if context.scope != "full":
        out = out.join(scoped_chats(segments.select(chat).distinct(), participants, allowlist, context, chat), chat, "left_semi")
    if filters.has_attachment is not None:
        if with_attachments is None:
            raise InvalidArgument("has_attachment needs the segments that have one")
        out = out.join(with_attachments.select(segment), segment, "left_semi" if filters.has_attachment else "left_anti")
    return out.select(segment)


def accepted_foreign(audit: DataFrame, owner: str, subject: str = "subject", ok: str = "subject_ok", surface: str = "surface") -> DataFrame:
    """One row: how many public requests of another subject than the owner were let through. It must be 0."""
    return audit.where((F.col(surface) == "public") & F.col(ok) & (F.col(subject) != owner)).agg(F.count("*").alias("accepted_foreign"))


# export


def revoke(allowlist: DataFrame, people: DataFrame, person: str = "person_id") -> DataFrame:
    """The allowlist after a revocation: rows stay, their flags are false; a person without a row gets one."""
    flags = [c for c in allowlist.columns if c != person]
    gone = people.select(person).distinct().withColumn("_gone", F.lit(True))
    both = allowlist.withColumn("_known", F.lit(True)).join(gone, person, "full_outer")
    return both.select(person, *[F.when(F.col("_gone"), False).otherwise(F.col(c)).alias(c) for c in flags])


def effective_sender(sender: Column, is_from_me: Column, owner: Column | int) -> Column:
    return F.coalesce(sender, F.when(is_from_me, owner if isinstance(owner, Column) else F.lit(owner)))


def not_allowed(people: DataFrame, allowlist: DataFrame, person: str = "person_id", flag: str = "text_allowed") -> DataFrame:
    """Rows whose person is not positively allowed: a null person or flag and a missing entry deny, and so does any entry that does where there are several."""
    told = allowlist.where(F.col(person).isNotNull()).groupBy(F.col(person).alias("_p")).agg(F.every(F.coalesce(flag, F.lit(False))).alias("_ok"))
    return people.join(told.where("_ok").select("_p"), F.col(person) == F.col("_p"), "left_anti")


def _tagged(evidence: dict[str, DataFrame], chat: str) -> DataFrame:
    """``(chat, reason)`` of all evidence, repeats included."""
    out = None
    for reason, rows in evidence.items():
        part = rows.select(chat, F.lit(reason).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def eligible_chats(chats: DataFrame, participants: DataFrame, evidence: dict[str, DataFrame], chat: str = "chat_id") -> DataFrame:
    """``(chat, participant_count, reasons, eligible)``: denied by any evidence, and by having no participants.

    ``evidence`` gives the chats that each reason denies; more evidence can only
    deny more. Reasons are sorted.
    """
    counts = participants.groupBy(chat).agg(F.countDistinct("person_id").alias("participant_count"))
    out = chats.select(chat).join(counts, chat, "left").withColumn("participant_count", F.coalesce("participant_count", F.lit(0)))
    none = F.array().cast("array<string>")
    if not evidence:
        out = out.withColumn("found", none)
    else:
        # A flag for each reason aggregates by hash; the list is made of the flags.
        flags = _tagged(evidence, chat).groupBy(chat).agg(*[F.max(F.when(F.col("reason") == r, True)).alias(f"_{i}") for i, r in enumerate(evidence)])
        listed = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(r)) for i, r in enumerate(evidence)]))
        out = out.join(flags.select(chat, listed.alias("found")), chat, "left")
    empty = F.when(F.col("participant_count") == 0, F.array(F.lit("no_participants"))).otherwise(none)
    reasons = F.array_sort(F.concat(F.coalesce("found", none), empty))
    return out.select(chat, "participant_count", reasons.alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


def attachment_gate(links: DataFrame, allowed: str = "allowed", unsent: str = "is_unsent") -> DataFrame:
    """``(segment_id, attachment_id, content_eligible)``: every message that is not unsent must allow it."""
    return links.where(~F.coalesce(unsent, F.lit(False))).groupBy("segment_id", "attachment_id").agg(F.every(F.coalesce(allowed, F.lit(False))).alias("content_eligible"))


def reconcile(desired: DataFrame, current: DataFrame, key: str = "document_id", content: str = "content_sha256") -> DataFrame:
    """``(key, action)``: upsert what is new or changed, delete what is no longer wanted, leave the rest."""
    d, c = desired.select(F.col(key), F.col(content).alias("_want"), F.lit(True).alias("_d")), current.select(F.col(key), F.col(content).alias("_have"), F.lit(True).alias("_c"))
    action = F.when(F.col("_d").isNull(), "delete").when(F.col("_c").isNull() | ~F.col("_want").eqNullSafe(F.col("_have")), "upsert").otherwise("unchanged")
    return d.join(c, key, "full_outer").select(key, action.alias("action"))


def scope_reasons(planned: DataFrame, pushed: DataFrame, dimension: str) -> DataFrame:
    """Members of ``dimension`` that are planned but were never pushed: each needs an approval."""
    return planned.select(dimension).distinct().join(pushed.select(dimension).distinct(), dimension, "left_anti")


def approval_reasons(planned: DataFrame, pushed: DataFrame, dimensions: dict[str, str], *, has_deletes: bool, config_changed: bool, first_push: bool, mode: str = "normal") -> list[str]:
    """Why a plan needs an approval. A purge needs none; a first push needs one whatever it holds."""
    if mode == "purge":
        return []
    if first_push:
        return ["first_push"]
    out = ["deletes"] if has_deletes else []
    out += [reason for reason, dimension in dimensions.items() if not scope_reasons(planned, pushed, dimension).isEmpty()]
    return out + (["config_changed"] if config_changed else [])
