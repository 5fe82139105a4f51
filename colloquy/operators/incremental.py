"""Incremental upkeep: scans, upserts, staleness, the outbox."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incremental_scan(messages: DataFrame, watermark: int, last_run: Column, row: str = "rowid", edited: str = "edited_at", retracted: str = "retracted_at") -> DataFrame:
    """New rows, and older ones edited or retracted since the last run; nothing is too late."""
    late = F.lit(False)
    for c in (edited, retracted):
        late = late | F.coalesce(F.col(c) > last_run, F.lit(False))
    return messages.where((F.col(row) > watermark) | late)


def advance_watermarks(state: DataFrame, scanned: DataFrame, source: str = "source", row: str = "rowid") -> DataFrame:
    """``(source, row)`` after a scan: the highest row seen of every source. It never goes back, and is to be written with the data."""
    seen = scanned.groupBy(source).agg(F.max(row).alias("_seen"))
    return state.join(seen, source, "full_outer").select(source, F.greatest(F.col(row), F.col("_seen")).alias(row))


def last_ok_runs(runs: DataFrame, source: str = "source", run: str = "run_id", finished: str = "finished_at", ok: str = "ok") -> DataFrame:
    """``(source, run, last_ok)``: the last run of each source that went well, and the latest time at which one did."""
    return runs.where(ok).groupBy(source).agg(F.max(run).alias(run), F.max(finished).alias("last_ok"))


def freshness(last_ok: DataFrame, now: Column, interval_seconds: int, at: str = "last_ok") -> DataFrame:
    """Adds ``age_seconds`` and ``fresh``: the last good run is less than two intervals old."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return last_ok.withColumns({"age_seconds": F.floor(age / 1_000_000), "fresh": age < 2 * interval_seconds * 1_000_000})


def active_chats(messages: DataFrame, now: Column, days: int = 90, chat: str = "chat_id", at: str = "sent_at") -> DataFrame:
    """``(chat, n, last_at)``: chats with messages within the days before now, the cutoff included."""
    cutoff = F.unix_micros(now.cast("timestamp")) - days * 86_400_000_000
    recent = messages.where(F.unix_micros(F.col(at).cast("timestamp")) >= cutoff)
    return recent.groupBy(chat).agg(F.count("*").alias("n"), F.max(at).alias("last_at"))


def first_chat(links: DataFrame, message: str = "message_id", chat: str = "chat_id") -> DataFrame:
    """A message of several chats belongs to the least."""
    return links.groupBy(message).agg(F.min(chat).alias(chat))


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str], update: Sequence[str], touched: str | None = "updated_at", now: Column | None = None) -> DataFrame:
    """The table after an upsert on a natural key.

    New keys come in whole, known ones take the columns ``update``, and only if
    one of them differs, so what has not changed is not touched. ``incoming`` has
    a row for each key.
    """
    now = F.current_timestamp() if now is None else now
    columns = current.columns
    old, new = current.alias("o"), incoming.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), condition, "full_outer")
    is_new, met = F.col("o._old").isNull(), F.col("o._old").isNotNull() & F.col("n._new").isNotNull()
    changed = F.lit(False)
    for c in update:
        changed = changed | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    out = []
    for c in columns:
        if c == touched:
            out.append(F.when(is_new | (met & changed), now).otherwise(F.col(f"o.{c}")).alias(c))
        elif c not in incoming.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in update:
            out.append(F.when(F.col("n._new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


@dataclass(frozen=True)
class Buckets:
    """A table in a folder, in which a key's hash tells the one folder of its rows."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int
    columns: T.StructType

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    @property
    def stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.columns.fields, T.StructField("_bucket", T.IntegerType())])).parquet(self.path)

    @property
    def rows(self) -> DataFrame:
        return self.stored.drop("_bucket")

    def write(self, rows: DataFrame) -> None:
        """Put the rows, which have their bucket, in place of those of the same buckets; others are left as they are."""
        dealt = rows.repartition("_bucket").sortWithinPartitions("_bucket", *self.key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)


def create_buckets(rows: DataFrame, path: str, key: Sequence[str], buckets: int) -> Buckets:
    """A new table of the rows; a bucket should hold what a few tasks can rewrite."""
    table = Buckets(rows.sparkSession, path, tuple(key), buckets, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]))
    table.write(rows.select("*", table.bucket()))
    return table


def upsert_buckets(table: Buckets, incoming: DataFrame, update: Sequence[str], touched: str | None = "updated_at", now: Column | None = None) -> int:
    """``upsert`` of a table in which only the buckets with a new or changed row are written; returns their number.

    Buckets are found by the keys that come in, so others are not read. Those to
    write are told first, from keys and updated columns alone, and no more than
    there are buckets; a bucket's files change together with its rows.
    """
    keys = list(table.key)
    news = incoming.select("*", table.bucket())
    names = [r[0] for r in news.select("_bucket").distinct().collect()]  # the number of buckets at most
    old = table.stored.where(F.col("_bucket").isin(names)).select("_bucket", *keys, *[F.col(c).alias(f"_{i}") for i, c in enumerate(update)], F.lit(True).alias("_there"))
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ["_bucket", *keys]]
    met = news.alias("n").join(old.alias("o"), reduce(Column.__and__, on), "left")
    changed = reduce(Column.__or__, [~F.col(f"n.{c}").eqNullSafe(F.col(f"o._{i}")) for i, c in enumerate(update)], F.col("o._there").isNull())
    write = [r[0] for r in met.where(changed).select("n._bucket").distinct().collect()]
    if not write:
        return 0
    after = upsert(table.stored.where(F.col("_bucket").isin(write)), news.where(F.col("_bucket").isin(write)), ["_bucket", *keys], update, touched, now)
    table.write(after)
    return len(write)


def fill_from(rows: DataFrame, source: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Fill nulls of ``column`` by a lookup; what is there stays."""
    looked = source.select(F.col(key), F.col(value).alias("_v"))
    return rows.join(looked, key, "left").withColumn(column, F.coalesce(F.col(column), F.col("_v"))).drop("_v")


def stale(content: DataFrame, derived: DataFrame, key: str, content_hash: str, derived_hash: str) -> DataFrame:
    """Rows whose derived form is absent or made from other content."""
    known = derived.select(F.col(key), F.col(derived_hash).alias("_h"))
    return content.join(known, key, "left").where(~F.col(content_hash).eqNullSafe(F.col("_h"))).drop("_h")


def absent(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a later step has not reached: messages in no segment, handles of no person."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def changed_since(messages: DataFrame, done: DataFrame, chat: str = "chat_id", at: str = "sent_at", done_at: str = "done_at") -> DataFrame:
    """Messages that changed after their chat was last worked on; chats that never were have changed throughout."""
    known = done.select(chat, F.col(done_at).alias("_done"))
    return messages.join(known, chat, "left").where(F.col("_done").isNull() | (F.col(at) > F.col("_done"))).drop("_done")


def config_stale(segments: DataFrame, current: str, group: str = "chat_id", config: str = "seg_config_hash") -> DataFrame:
    """``(group)`` with a segment that was made under another configuration, or under none that is known."""
    return segments.where(~F.col(config).eqNullSafe(F.lit(current))).select(group).distinct()


def dirty_chats(unsegmented: DataFrame, changed: DataFrame, chat: str = "chat_id", at: str = "sent_at") -> DataFrame:
    """``(chat, earliest)``: chats with messages in no segment, or changed since they were segmented."""
    both = unsegmented.groupBy(chat).agg(F.min(at).alias("earliest")).unionByName(changed.groupBy(chat).agg(F.min(at).alias("earliest")))
    return both.groupBy(chat).agg(F.min("earliest").alias("earliest"))


def last_events(events: DataFrame, after: int = 0, key: Sequence[str] = ("entity_kind", "entity_id")) -> DataFrame:
    """The last event of each entity after a position: upserts read current content, so it alone decides."""
    return events.where(F.col("event_id") > after).groupBy(*key).agg(F.max("event_id").alias("event_id"), F.max_by("operation", "event_id").alias("operation"))


def apply_outbox(index: DataFrame, events: DataFrame, content: DataFrame, after: int = 0, key: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """``(index, outcome)`` after the events beyond ``after``.

    Of each entity the last event counts: a delete removes it, an upsert puts its
    current content, one whose content is gone is skipped and leaves the entity
    out. The outcome tells applied, deleted or skipped for every entity touched.
    """
    last = last_events(events, after, [key])
    put = last.where("operation = 'upsert'").join(content, key).select(*index.columns)
    kept = index.join(last, key, "left_anti").select(*index.columns)
    known = content.select(F.col(key), F.lit(True).alias("_there"))
    told = F.when(F.col("operation") == "delete", "deleted").when(F.col("_there").isNull(), "skipped").otherwise("applied")
    return kept.unionByName(put), last.join(known, key, "left").select(key, "event_id", told.alias("outcome"))


def backfill_reactions(reactions: DataFrame, messages: DataFrame) -> DataFrame:
    """Reactions that came before their message get its id once it is there."""
    return fill_from(reactions, messages.select(F.col("source_guid").alias("target_guid"), "message_id"), "target_guid", "target_message_id", "message_id")


def numbered(rows: DataFrame, within: Sequence[str], by: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Position of each row in its group: ordinals of attachments, versions of edits."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)) - 1 + start)


def set_difference(a: DataFrame, b: DataFrame, exceptions: DataFrame | None, key: str = "guid") -> DataFrame:
    """``(key, side, accepted)``: what only one side has, and whether that was accepted beforehand."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    only = x.join(y, key, "left_anti").withColumn("side", F.lit("only_a")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("only_b")))
    if exceptions is None:
        return only.withColumn("accepted", F.lit(False))
    known = exceptions.select(key).distinct().withColumn("_ok", F.lit(True))
    return only.join(known, key, "left").select(key, "side", F.coalesce("_ok", F.lit(False)).alias("accepted"))


def migration_state(applied: DataFrame, on_disk: DataFrame) -> DataFrame:
    """``(version, state)``: pending, applied, changed since (hash), or missing on disk."""
    a, d = applied.select("version", F.col("sha256").alias("_a")), on_disk.select("version", F.col("sha256").alias("_d"))
    state = F.when(F.col("_a").isNull(), "pending").when(F.col("_d").isNull(), "missing").when(F.col("_a") != F.col("_d"), "hash_mismatch").otherwise("applied")
    return a.join(d, "version", "full_outer").select("version", state.alias("state"))
