"""Sessions, segments and conversation windows.

No task needs a whole chat or session. Rows are dealt by key and stretch (of time,
or of positions); what a stretch needs from those before it, sums and last times,
comes from a table with a row for each key and stretch. Null keys are a key, and
a null time comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import estimate_tokens
from colloquy.session import map_batches, shared_dir

Boundaries = Callable[[Sequence[str]], list[int]]
HOUR = 3_600_000_000
#: Rows of a session that a task holds at a time.
STRETCH = 4096


class BoundaryFailure(RuntimeError):
    """A provider of boundaries cannot answer; anything else that it raises is an error of the program."""


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _key(names: Sequence[str]) -> Column:
    """The key as one value, of which nulls inside are equal to each other."""
    return F.struct(*names).alias("_k")


def _cumulated(rows: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of ``_k`` up to each; ``_b`` numbers the stretches in that order."""
    inside = Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_k", F.struct("_b").alias("_s")).agg(F.sum(value).alias("_n"))
    offsets = totals.select("_k", "_s", F.coalesce(F.sum("_n").over(before.orderBy("_s")), F.lit(0)).alias("_offset"))
    own = rows.withColumn("_s", F.struct("_b")).withColumn("_inner", F.sum(value).over(inside))
    return own.join(offsets, ["_k", "_s"]).withColumn(name, F.col("_offset") + F.col("_inner")).drop("_s", "_offset", "_inner")


def sessionize(messages: DataFrame, gap_hours: float, chat: str = "chat_id", at: str = "sent_at", tie: str = "message_id", bucket_hours: int = 24) -> DataFrame:
    """Adds ``session_no`` (from 0 in each chat): a new session begins where the gap is exceeded, not where it is met.

    A message without a time begins no session and ends none; those without a
    chat are one chat.
    """
    gap = int(gap_hours * HOUR)
    rows = messages.withColumns({"_k": _key([chat]), "_t": _micros(at)}).withColumn("_s", F.struct(F.floor(F.col("_t") / F.lit(bucket_hours * HOUR)).alias("b")))
    inside = Window.partitionBy("_k", "_s").orderBy(at, tie)
    opens = lambda previous: F.coalesce((F.col("_t") - previous > gap).cast("int"), F.lit(0))
    inner = rows.withColumn("_own", opens(F.lag("_t").over(inside)))
    stretches = inner.groupBy("_k", "_s").agg(F.min("_t").alias("_t"), F.max("_t").alias("_end"), F.sum("_own").alias("_n"))
    order = Window.partitionBy("_k").orderBy("_s")
    crossed = stretches.withColumn("_first", opens(F.lag("_end").over(order)))
    offsets = crossed.select("_k", "_s", (F.sum(F.col("_first") + F.col("_n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"))
    numbered = inner.join(offsets, ["_k", "_s"])
    return numbered.select(*messages.columns, (F.col("_offset") + F.sum("_own").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("session_no"))


def positioned(rows: DataFrame, keys: Sequence[str], at: str, tie: str, name: str, bucket_hours: int = 24) -> DataFrame:
    """Adds the position of each row (from 0) in its key's order of time."""
    dealt = rows.withColumns({"_k": _key(keys), "_b": F.floor(_micros(at) / F.lit(bucket_hours * HOUR))})
    return _cumulated(dealt, [at, tie], F.lit(1), name).withColumn(name, F.col(name) - 1).drop("_k", "_b")


def summarize_sessions(sessions: DataFrame, chat: str = "chat_id", at: str = "sent_at", tie: str = "message_id") -> DataFrame:
    """One row per session: times, size, and the first and last message."""
    key = F.struct(at, tie)
    return sessions.groupBy(chat, "session_no").agg(
        F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count("*").alias("message_count"),
        F.min_by(tie, key).alias("first_message"), F.max_by(tie, key).alias("last_message"),
    )


def recompute_start(sessions: DataFrame, changes: DataFrame, gap_hours: float, chat: str = "chat_id") -> DataFrame:
    """``(chat, recompute_from)``: where the sessions of a changed chat must be rebuilt.

    ``sessions`` has started_at and ended_at, ``changes`` the earliest changed_at
    of each chat. The last session that ended more than a gap before the change
    is sealed; rebuilding starts with the session after it, or with the change.
    A change exactly a gap later would join that session, so it is not sealed:
    thus an incremental run agrees with a full one.
    """
    order = Window.partitionBy(chat).orderBy("started_at")
    joined = changes.select(chat, "changed_at").join(sessions.select(chat, "started_at", "ended_at", F.lead("started_at").over(order).alias("next_start")), chat, "left")
    sealed = F.col("ended_at").isNotNull() & (_micros("ended_at") + int(gap_hours * HOUR) < _micros("changed_at"))
    found = joined.groupBy(chat, "changed_at").agg(
        F.max_by(F.struct("next_start"), F.when(sealed, F.col("started_at"))).alias("sealed"), F.max(F.when(sealed, F.col("started_at"))).alias("any"), F.min("started_at").alias("first"),
    )
    start = F.when(F.col("first").isNull(), F.col("changed_at")).when(F.col("any").isNotNull(), F.coalesce("sealed.next_start", "changed_at")).otherwise(F.least("first", "changed_at"))
    return found.select(chat, start.alias("recompute_from"))


# folds over the rows of a session


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal."""
    if pa.types.is_struct(column.type):
        parts = [_changes(x) for x in column.flatten()]
        return np.logical_or.reduce(parts) if parts else np.zeros(max(0, len(column) - 1), bool)
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    both = pc.and_(a.is_null(), b.is_null())
    return pc.if_else(both, False, pc.fill_null(pc.not_equal(a, b), True)).to_numpy(zero_copy_only=False)


def _grouped(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        if not rows.num_rows:
            continue
        change = np.zeros(rows.num_rows - 1, dtype=bool)
        for n in names:
            change |= _changes(rows.column(n).chunk(0))
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield rows.slice(x, y - x)
        held = rows.slice(cuts[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def next_starts(costs: np.ndarray, resets: np.ndarray, most: int, budget: int) -> np.ndarray:
    """For every row where the next group begins if one begins there: found by binary search in the sums of costs."""
    n = len(costs)
    sums = np.concatenate([[0], np.cumsum(costs)])
    by_cost = np.searchsorted(sums, sums[:-1] + budget, "right") - 1
    reset = np.append(np.flatnonzero(resets), n)
    by_reset = reset[np.searchsorted(reset, np.arange(n), "right")]
    return np.minimum(np.maximum(np.minimum(by_cost, np.arange(n) + most), np.arange(n) + 1), by_reset)


def _fold_stretches(rows: DataFrame, most: int, budget: int, stretch: int, schema: str, mark: bool) -> DataFrame:
    """Work on the stretches of ``(_k, _b, _i, _cost, _reset, _entry)``, which have the first ``most`` rows of the next stretch too.

    Either ``(_k, entry, leave)``, where a group that begins at one of the first
    rows leads to the first that begins in the next stretch; or ``(_k, _i,
    _start)``, which rows of the stretch begin a group, given its entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["_k", "_b"]):
            block = table.column("_b")[0].as_py()
            at, entry = table.column("_i").to_numpy(), table.column("_entry").to_numpy()
            rows_only = np.flatnonzero(~entry)
            at_rows, first = at[rows_only], block * stretch
            costs, resets = table.column("_cost").to_numpy()[rows_only], table.column("_reset").to_numpy()[rows_only]
            following = next_starts(costs, resets, most, budget)
            own = int(np.searchsorted(at_rows, first + stretch))
            keys = table.column("_k").combine_chunks()
            if mark:
                start = np.zeros(own, dtype=bool)
                given = at[entry] - first
                place = int(given[0]) if len(given) else 0 if block == 0 else own
                while place < own:
                    start[place] = True
                    place = int(following[place])
                taken = keys.take(pa.array(rows_only[:own]))
                yield pa.RecordBatch.from_arrays([taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken, pa.array(at_rows[:own]), pa.array(start)], ["_k", "_i", "_start"])
            elif len(at_rows) > own:
                leave = following.copy()
                for i in range(own - 1, -1, -1):
                    if leave[i] < own:
                        leave[i] = leave[leave[i]]
                n = 1 if block == 0 else min(most, own)
                taken = keys.take(pa.array(rows_only[:n]))
                yield pa.RecordBatch.from_arrays([taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken, pa.array(at_rows[:n]), pa.array(leave[:n] + first)], ["_k", "entry", "leave"])

    return map_batches(rows.repartition("_k", "_b").sortWithinPartitions("_k", "_b", "_i", "_entry"), run, schema)


def _reached(edges: DataFrame) -> DataFrame:
    """``(_k, entry)``: where groups begin in later stretches, by doubling the pointers from the first row."""
    shared_dir(edges.sparkSession)
    jump = edges.checkpoint()
    reached = jump.where("entry = 0").select("_k", F.lit(0).cast("long").alias("entry")).distinct()
    while not jump.isEmpty():
        met = reached.join(jump, ["_k", "entry"]).select("_k", F.col("leave").alias("entry"))
        reached = reached.unionByName(met).distinct().checkpoint()
        jump = jump.join(jump.select("_k", F.col("entry").alias("leave"), F.col("leave").alias("further")), ["_k", "leave"]).select("_k", "entry", F.col("further").alias("leave")).checkpoint()
    return reached.where("entry > 0")


def split_capped(rows: DataFrame, keys: Sequence[str], position: str, cost: str, most: int, budget: int, reset: str | None = None, name: str = "part", stretch: int = STRETCH) -> DataFrame:
    """Adds the number of each row's group within its key (from 0): a new one where the count would exceed ``most`` or the sum of costs ``budget``.

    ``position`` numbers the rows of a key from 0; a row whose ``reset`` is true
    begins a group whatever came before. Where a row's group would end is found
    by binary search in sums; in each stretch of rows these pointers are followed
    at once, from stretch to stretch they are doubled. So a task holds one
    stretch and ``most`` more rows, and keys of any size take log steps.
    """
    if not 0 < most <= stretch:
        raise ValueError("most must be from 1 to the stretch")
    told = F.lit(False) if reset is None else F.coalesce(F.col(reset), F.lit(False))
    bare = rows.select(_key(keys), F.col(position).cast("long").alias("_i"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("_cost"), told.alias("_reset"), F.lit(False).alias("_entry"))
    own = F.floor(F.col("_i") / stretch).cast("long")
    early = (F.col("_i") % stretch < most) & (own > 0)
    dealt = bare.select("*", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))).alias("_b"))
    kind = dealt.select("_k").schema["_k"].dataType.simpleString()
    long = bare.where(F.col("_i") >= stretch).select("_k").distinct()
    dealt_long = None if long.isEmpty() else dealt.join(long, "_k", "left_semi")  # others have no further stretch to enter
    given = dealt.limit(0).select("_k", F.lit(0).cast("long").alias("entry")) if dealt_long is None else _reached(_fold_stretches(dealt_long, most, budget, stretch, f"_k {kind}, entry long, leave long", mark=False))
    given = given.select("_k", F.col("entry").alias("_i"), F.lit(0).cast("long").alias("_cost"), F.lit(False).alias("_reset"), F.lit(True).alias("_entry"), F.floor(F.col("entry") / stretch).cast("long").alias("_b"))
    marked = _fold_stretches(dealt.unionByName(given), most, budget, stretch, f"_k {kind}, _i long, _start boolean", mark=True)
    numbered = _cumulated(marked.withColumn("_b", F.floor(F.col("_i") / stretch)), ["_i"], F.col("_start").cast("int"), name)
    parts = numbered.select("_k", "_i", (F.col(name) - 1).alias(name))
    return rows.withColumns({"_k": _key(keys), "_i": F.col(position).cast("long")}).join(parts, ["_k", "_i"]).drop("_k", "_i")


def every_five(window: Sequence[str]) -> list[int]:
    """A stand-in for a model: a boundary at every fifth message."""
    return list(range(5, len(window), 5))


def ask_boundaries(provider: Boundaries, window: Sequence[str]) -> list[int] | None:
    """Boundaries within a window, or none if the provider fails twice or tells places that are not inside."""
    for _ in range(2):
        try:
            found = provider(window)
        except BoundaryFailure:
            continue
        return None if any(not 0 < b < len(window) for b in found) else found
    return None


def topic_windows(rows: DataFrame, keys: Sequence[str], position: str, text: str = "text", provider: Boundaries | None = None, window_tokens: int = 4000, overlap: int = 10) -> DataFrame:
    """``(_k, start, end, cuts)``: the windows of each session's messages, and the places that the provider tells in them (null if it fails).

    A window has messages up to the token budget, one at least; the next begins
    ``overlap`` messages before its end. Rows pass by in order, and a task holds
    the messages of one window.
    """
    source = rows.select(_key(keys), F.col(position).cast("long").alias("_i"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = source.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: pa.Array | None = None
        held: list[str] = []
        costs: list[int] = []
        start = total = 0
        done: list[tuple] = []

        def told(last: pa.Array | None) -> Iterator[pa.RecordBatch]:
            if done and last is not None:
                yield pa.RecordBatch.from_arrays(
                    [last.take(pa.array([0] * len(done))), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.list_(pa.int64()))],
                    ["_k", "start", "end", "cuts"],
                )
                done.clear()

        def close() -> None:
            found = ask_boundaries(provider or every_five, held)
            done.append((start, start + len(held), None if found is None else sorted({start + b for b in found})))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys_here = batch.column(0)
            change = np.concatenate([[True], _changes(keys_here)])
            if key is not None and not _changes(pa.concat_arrays([key, keys_here.slice(0, 1)]))[0]:
                change[0] = False
            for j, (text_here, fresh) in enumerate(zip(batch.column(2).to_pylist(), change.tolist(), strict=True)):
                if fresh:
                    if held:
                        close()
                    yield from told(key)
                    key, held, costs, start, total = keys_here.slice(j, 1), [], [], 0, 0
                cost = -(-len(text_here) // 4)
                while held and total + cost > window_tokens:
                    close()
                    gone = max(len(held) - overlap, 1)
                    start += gone
                    total -= sum(costs[:gone])
                    held, costs = held[gone:], costs[gone:]
                held.append(text_here)
                costs.append(cost)
                total += cost
            yield from told(key)
        if held:
            close()
            yield from told(key)

    ordered = source.repartition("_k").sortWithinPartitions("_k", "_i")
    return map_batches(ordered, run, f"_k {kind}, start long, end long, cuts array<long>")


def topic_starts(windows: DataFrame, least: int = 2) -> DataFrame:
    """``(_k, at)``: where topics begin, of the places told in all windows of a session; none for a session with a failed window.

    The session's first row begins one; a place less than ``least`` rows after
    the last that counts is left out, and so is the last if less than ``least``
    rows follow it. A session's places pass by in order.
    """
    failed = windows.where("cuts is null").select("_k").distinct()
    good = windows.join(failed, "_k", "left_anti")
    ends = good.groupBy("_k").agg(F.max("end").alias("n"))
    places = good.select("_k", F.explode("cuts").alias("at")).distinct().join(ends, "_k")
    kind = places.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: pa.Array | None = None
        last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys_here = batch.column(0)
            change = np.concatenate([[True], _changes(keys_here)])
            if key is not None and not _changes(pa.concat_arrays([key, keys_here.slice(0, 1)]))[0]:
                change[0] = False
            good = np.zeros(batch.num_rows, dtype=bool)
            for j, (at, n, fresh) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), change.tolist(), strict=True)):
                if fresh:
                    last = 0
                if at - last >= least and n - at >= least:
                    good[j], last = True, at
            key = keys_here.slice(len(keys_here) - 1, 1)
            yield batch.filter(pa.array(good)).select(["_k", "at"])

    return map_batches(places.select("_k", "at", "n").repartition("_k").sortWithinPartitions("_k", "at"), run, f"_k {kind}, at long")


def segment_sessions(messages: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text", provider: Boundaries = every_five, topical_min: int = 6, most: int = 50, budget: int = 3000, window_tokens: int = 4000, overlap: int = 10, least: int = 2) -> DataFrame:
    """``keys``, ``order``, ``seq_in_session`` and ``topic_label`` of every message of sessions.

    A session of ``topical_min`` messages or less is one group, and so is one in
    which the provider fails, which its label tells. Others are cut into topics,
    and these where they exceed the caps.
    """
    columns = [*keys, *order]
    rows = positioned(messages.select(*columns, text), keys, order[0], order[-1], "_at").withColumns({"_k": _key(keys), "_cost": estimate_tokens(F.col(text))})
    rows = rows.join(rows.groupBy("_k").agg(F.count("*").alias("_size")), "_k")
    shared_dir(messages.sparkSession)
    # Written once, with the texts of those sessions only that the provider sees; and so is what it tells: both are read several times.
    rows = rows.withColumn(text, F.when(F.col("_size") > topical_min, F.col(text))).checkpoint()
    large = rows.where(F.col("_size") > topical_min)
    windows = topic_windows(large.drop("_k"), keys, "_at", text, provider, window_tokens, overlap).checkpoint()
    begins = topic_starts(windows, least).select("_k", F.col("at").alias("_at"), F.lit(True).alias("_reset"))
    failed = windows.where("cuts is null").select("_k").distinct().withColumn("_failed", F.lit(True))
    cut = large.join(begins, ["_k", "_at"], "left").drop("_k")
    parts = split_capped(cut, keys, "_at", "_cost", most, budget, "_reset", "seq_in_session")
    label = F.when(F.col("_failed"), F.lit("fallback:session"))
    done = parts.withColumn("_k", _key(keys)).join(failed, "_k", "left")
    whole = rows.where(F.col("_size") <= topical_min).select(*columns, F.lit(0).alias("seq_in_session"), F.lit(None).cast("string").alias("topic_label"))
    return done.select(*columns, F.when(F.col("_failed"), 0).otherwise(F.col("seq_in_session")).cast("int").alias("seq_in_session"), label.alias("topic_label")).unionByName(whole)


def conversation_windows(messages: DataFrame, anchors: DataFrame, size: int, chat: str = "chat_id", at: str = "sent_at", tie: str = "message_id", bucket_hours: int = 24) -> DataFrame:
    """Messages around each ``(chat, anchor_at)``: ``size`` before it and ``size + 1`` from it on, ``offset`` being counted from the anchor.

    Anchors and messages are numbered in one order; an anchor then asks for the
    messages at its own position and next to it, so the work is that of one sort
    and of the rows that come out. Repeated anchors count once; one without a
    time has all messages that have one from it on.
    """
    stretch = lambda t: F.floor(_micros(t) / F.lit(bucket_hours * HOUR))
    asked = anchors.select(chat, "anchor_at").where(F.col(chat).isNotNull() & F.col("anchor_at").isNotNull()).distinct()
    own = messages.where(F.col(chat).isNotNull() & F.col(at).isNotNull()).withColumns({"_k": _key([chat]), "_b": stretch(at)})
    ids = own.select("_k", "_b", _micros(at).alias("_t"), F.lit(1).alias("_m"), F.col(tie).alias("_tie"), F.lit(None).cast(anchors.schema["anchor_at"].dataType).alias("anchor_at"))
    marks = asked.select(_key([chat]), stretch("anchor_at").alias("_b"), _micros("anchor_at").alias("_t"), F.lit(0).alias("_m"), F.lit(None).cast(messages.schema[tie].dataType).alias("_tie"), "anchor_at")
    numbered = _cumulated(ids.unionByName(marks), ["_t", "_m", "_tie"], F.col("_m"), "_at")
    wanted = numbered.where("_m = 0").select("_k", "anchor_at", F.explode(F.sequence(F.lit(-size).cast("long"), F.lit(size).cast("long"))).alias("offset"), "_at").withColumn("_at", F.col("_at") + F.col("offset"))
    placed = _cumulated(own, [at, tie], F.lit(1), "_at").withColumn("_at", F.col("_at") - 1)
    return placed.join(wanted, ["_k", "_at"]).select(*messages.columns, "anchor_at", "offset")


def first_message(members: DataFrame, segment: str = "segment_id", at: str = "sent_at", tie: str = "message_id", guid: str = "source_guid") -> DataFrame:
    """``(segment, anchor_guid)``: a segment is labelled by its first message."""
    return members.groupBy(segment).agg(F.min_by(guid, F.struct(at, tie)).alias("anchor_guid"))


def token_cost(text: str = "text") -> Column:
    return estimate_tokens(F.col(text))
