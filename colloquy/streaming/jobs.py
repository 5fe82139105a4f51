"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.operators.incremental import last_events
from colloquy.session import ship_package


def stream_sessions(events: DataFrame, gap: str = "3 hours", lateness: str = "1 day", key: str = "user_id", at: str = "ts") -> DataFrame:
    """Sessions of an event stream; an event exactly a gap later still belongs. Events later than ``lateness`` are dropped by the watermark, unlike in the batch form."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    grouped = timed.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("message_count"), F.min(at).alias("started_at"), F.max(at).alias("ended_at"))
    return grouped.drop("session_window")


def consume_outbox(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand the last event of every entity of each batch to ``apply``; the checkpoint is the position.

    A batch that is repeated after a failure applies the same events again, and
    as upserts read current content that changes nothing.
    """
    def run(batch: DataFrame, number: int) -> None:
        apply(last_events(batch), number)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_rate_limit(events: DataFrame, limit: int, window_seconds: float, key: str = "user_id", at: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Verdicts per event of a stream; the state of a key is the accepted times within the window, ``limit`` at most.

    A key that is silent for longer than the window by the watermark is forgotten.
    """
    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values([at, "event_id"])
            verdicts = []
            for t in (x.value / 1e9 for x in frame[at]):
                kept = [k for k in kept if k > t - window_seconds]
                verdicts.append(len(kept) < limit)
                if verdicts[-1]:
                    kept.append(t)
            yield pd.DataFrame({key: name[0], "event_id": frame["event_id"], "allowed": verdicts})
        state.update((kept,))
        if kept:
            state.setTimeoutTimestamp(max(int((kept[-1] + window_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


# keyed state that forgets nothing: whatever comes late is still applied

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """``transformWithState`` by a key; it needs the state store that keeps state on disk."""
    spark = rows.sparkSession
    ship_package(spark)
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="None")


class _Reactions(StatefulProcessor):
    """Of a message its id once it is there; until then the reactions that wait for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.message = handle.getValueState("message", "message_id long")
        self.waiting = handle.getListState("waiting", "tapback_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = []
        found = self.message.get()[0] if self.message.exists() else None
        before = found
        for r in rows:
            if r["tapback_id"] is None:
                found = r["message_id"] if found is None else min(found, r["message_id"])
            else:
                came.append(r["tapback_id"])
        if found is None:
            self.waiting.appendList([(t,) for t in came])
            return
        if found != before:
            self.message.update((found,))
        if before is None and self.waiting.exists():
            came = [*(w[0] for w in self.waiting.get()), *came]
            self.waiting.clear()
        for t in came:
            yield Row(tapback_id=t, target_message_id=found)

    def close(self) -> None:
        pass


def stream_reactions(messages: DataFrame, reactions: DataFrame) -> DataFrame:
    """``(tapback_id, target_message_id)`` of the streams ``(source_guid, message_id)`` and ``(target_guid, tapback_id)``, as soon as both have come, in whatever order.

    As ``backfill_reactions`` of all rows, without the reactions whose message
    never comes. Rows without a guid are nobody's; of messages of one guid the
    first to come counts, the least id where several come at once.
    """
    there = messages.where(F.col("source_guid").isNotNull()).select(F.col("source_guid").alias("guid"), F.col("message_id").cast("long").alias("message_id"), F.lit(None).cast("long").alias("tapback_id"))
    back = reactions.where(F.col("target_guid").isNotNull()).select(F.col("target_guid").alias("guid"), F.lit(None).cast("long").alias("message_id"), F.col("tapback_id").cast("long").alias("tapback_id"))
    return _stateful(there.unionByName(back), "guid", _Reactions(), "tapback_id long, target_message_id long", "Append")


class _Edits(StatefulProcessor):
    """Of a message the version that counts: that of the latest edit, however late it comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "edited long, text string, edits long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        edited, text, edits = self.version.get() if self.version.exists() else (None, None, 0)
        for r in rows:
            edits += 1
            own = (r["edited"], r["text"] is not None, r["text"] or "")
            if edited is None or own > (edited, text is not None, text or ""):
                edited, text = r["edited"], r["text"]
        self.version.update((edited, text, edits))
        yield Row(message_id=key[0], edited_micros=edited, text=text, edits=edits)

    def close(self) -> None:
        pass


def stream_edits(edits: DataFrame) -> DataFrame:
    """``(message_id, edited_micros, text, edits)`` of the stream ``(message_id, edited_at, text)``: a row for a message whenever an edit of it comes.

    The last row of a message tells its latest edit and how many there were,
    whatever the order of batches. Of edits at one time the greater text counts;
    rows without a message or a time tell nothing.
    """
    rows = edits.where("message_id is not null and edited_at is not null")
    return _stateful(rows.select("message_id", F.unix_micros(F.col("edited_at").cast("timestamp")).alias("edited"), "text"), "message_id", _Edits(), "message_id long, edited_micros long, text string, edits long", "Update")


class _Sessions(StatefulProcessor):
    """The sessions of a key as ``(start, end, count)``; an event joins what is within the gap, and may unite two of them."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getListState("sessions", "start long, end long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = [tuple(x) for x in self.sessions.get()] if self.sessions.exists() else []
        parts = sorted([(*x, True) for x in known] + [(r["t"], r["t"], 1, False) for r in rows])
        kept: list[tuple[int, int, int]] = []
        changed: list[tuple[int, list[int]]] = []
        for start, end, n, old in parts:
            if kept and start - kept[-1][1] <= self.gap:
                kept[-1] = (kept[-1][0], max(kept[-1][1], end), kept[-1][2] + n)
                changed[-1][1].append(start if old else -1)
            else:
                kept.append((start, end, n))
                changed.append((start, [start if old else -1]))
        self.sessions.put(kept)
        for (start, end, n), (_, members) in zip(kept, changed, strict=True):
            if -1 in members:
                yield Row(key=key[0], start=start, end=end, n=n, replaces=[m for m in members if m not in (-1, start)])

    def close(self) -> None:
        pass


def stream_sessions_kept(events: DataFrame, gap_hours: float, key: str = "user_id", at: str = "ts") -> DataFrame:
    """``(key, started_at, ended_at, message_count, replaces)``: sessions of an event stream in which no event is too late.

    A session is told again whenever an event comes to it; ``replaces`` has the
    starts of sessions told before that it now takes in. Upserts by key and
    start, and deletes of what is replaced, give the batch form's sessions
    whatever the order of the events, if their times are past 1970. The state of
    a key is a row for each of its sessions. Events without a key or time have none.
    """
    timed = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    kind = timed.schema["key"].dataType.simpleString()
    told = _stateful(timed, "key", _Sessions(int(gap_hours * 3_600_000_000)), f"key {kind}, start long, end long, n long, replaces array<long>", "Update")
    moment = lambda c: F.timestamp_micros(c)
    return told.select(F.col("key").alias(key), moment("start").alias("started_at"), moment("end").alias("ended_at"), F.col("n").alias("message_count"), F.transform("replaces", moment).alias("replaces"))


def stream_watermarks(rows: DataFrame, source: str = "source", row: str = "rowid") -> DataFrame:
    """``(source, row)``: the highest row seen of every source of a stream, whatever its order; never lower than before."""
    return rows.where(F.col(source).isNotNull()).groupBy(source).agg(F.max(row).alias(row))
