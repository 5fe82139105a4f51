"""Work queues and limits as state transitions over a table. One writer at a time applies them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.times import after_seconds, backoff_seconds
from colloquy.session import map_batches

LEASE_SECONDS = 900
#: Enrichments of each kind of media.
ROUTES = {"pdf": ("pdf_text",), "image": ("ocr", "caption"), "audio": ("transcript",), "video": ("frame_ocr", "caption", "transcript")}


def routes(kind: Column) -> Column:
    """The enrichments that a kind of media needs; null for one that has no route."""
    out = F.lit(None).cast("array<string>")
    for name, kinds in ROUTES.items():
        out = F.when(kind == name, F.array(*map(F.lit, kinds))).otherwise(out)
    return out


def enqueue(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(attachment_id, kind)`` of the wanted tasks that the queue lacks; those in it, in any state, stay as they are."""
    return wanted.select("attachment_id", "kind").distinct().join(queue, ["attachment_id", "kind"], "left_anti")


def is_claimable(now: Column, lease_seconds: int = LEASE_SECONDS) -> Column:
    expired = F.unix_micros(F.col("locked_at").cast("timestamp")) < F.unix_micros(now.cast("timestamp")) - lease_seconds * 1_000_000
    return (F.col("next_attempt_at") <= now) & ((F.col("state") == "pending") | ((F.col("state") == "running") & F.coalesce(expired, F.lit(False))))


def claim(queue: DataFrame, now: Column, limit: int, worker: str, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """The tasks that a worker gets: the first ``limit`` that may run, including those of expired leases."""
    picked = queue.where(is_claimable(now, lease_seconds)).orderBy("next_attempt_at", "attachment_id", "kind").limit(limit)
    return picked.withColumn("state", F.lit("running")).withColumn("locked_at", now).withColumn("locked_by", F.lit(worker))


def settle(queue: DataFrame, results: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """The queue after ``results`` ``(attachment_id, kind, outcome)``: done, skipped, failed for good, or an error.

    An error goes back to pending after an exponential pause, or fails when the
    attempts are used up. The lease ends in any case.
    """
    joined = queue.join(results.select("attachment_id", "kind", "outcome"), ["attachment_id", "kind"], "left")
    is_error, hit = F.col("outcome") == "error", F.col("outcome").isNotNull()
    attempts = F.when(is_error, F.col("attempts") + 1).otherwise(F.col("attempts"))
    spent = attempts >= most_attempts
    state = F.when(F.col("outcome").isin("done", "skipped"), F.col("outcome")).when((F.col("outcome") == "permanent") | (is_error & spent), "failed").when(is_error, "pending").otherwise(F.col("state"))
    pause = F.when(is_error & ~spent, after_seconds(now.cast("timestamp"), backoff_seconds(attempts)).cast(queue.schema["next_attempt_at"].dataType)).otherwise(F.col("next_attempt_at"))
    new = {"state": state, "attempts": attempts.cast("int"), "next_attempt_at": pause, "locked_at": F.when(~hit, F.col("locked_at")), "locked_by": F.when(~hit, F.col("locked_by"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])


def materialize_step(rows: DataFrame, outcome: str = "outcome", most: int = 3) -> DataFrame:
    """The state of an attachment's file after a try: there, still elsewhere, in error, or missing after ``most`` tries."""
    tries = F.col("attempts") + (F.col(outcome) != "present").cast("int")
    state = F.when(F.col(outcome) == "present", "materialized").when(F.col(outcome) == "error", "error").when(tries >= most, "missing").otherwise("dataless")
    return rows.withColumns({"attempts": tries, "state": state})


def accept_within(times: list[float], limit: int, window: float) -> list[bool]:
    """Sliding-window verdicts on ascending times: only accepted events count, those ``window`` old have left."""
    kept: list[float] = []
    out = []
    for t in times:
        kept = [x for x in kept if x > t - window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def rate_limited(events: DataFrame, limit: int, window_seconds: float, key: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds ``allowed``. What is refused does not count, so verdicts follow one another: a fold over each key's sorted events.

    A task holds one batch and the accepted times of one key, ``limit`` at most.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    span = int(window_seconds * 1_000_000)
    timed = events.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, accepted = object(), deque()
        for rows in batches:
            verdicts = []
            for own, t in zip(rows.column(key).to_pylist(), rows.column("_t").to_pylist(), strict=True):
                if own != name:
                    name, accepted = own, deque()
                while t is not None and accepted and accepted[0] <= t - span:
                    accepted.popleft()
                verdicts.append(len(accepted) < limit)
                if verdicts[-1] and t is not None:
                    accepted.append(t)
            kept = rows.drop_columns(["_t"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(verdicts, pa.bool_())], [*kept.schema.names, "allowed"])

    return map_batches(timed.repartition(key).sortWithinPartitions(key, at, tie), run, schema)


class VerdictCache:
    """Verdicts of an outside authority, remembered for a while; after a failure it is not asked for some seconds.

    ``ask`` returns ``(verdict, seconds it holds)`` or raises. A refusal is kept
    for ``most_refused`` seconds at most, and while the authority is left alone
    every unknown name is refused.
    """

    def __init__(self, ask: Callable[[str], tuple[bool, float]], clock: Callable[[], float], most_refused: float = 60.0, pause: float = 5.0):
        self.ask, self.clock, self.most_refused, self.pause = ask, clock, most_refused, pause
        self.known: dict[str, tuple[bool, float]] = {}
        self.closed_until = float("-inf")

    def verdict(self, name: str) -> bool:
        now = self.clock()
        self.known = {k: v for k, v in self.known.items() if v[1] > now}
        if name in self.known:
            return self.known[name][0]
        if now < self.closed_until:
            return False
        try:
            allowed, seconds = self.ask(name)
        except Exception:
            self.closed_until = now + self.pause
            return False
        self.known[name] = (allowed, now + (seconds if allowed else min(seconds, self.most_refused)))
        return allowed


def paced(n: Column, per_minute: float) -> Column:
    """Seconds after its start at which the n-th task of a worker (from 0) may begin: evenly spaced, without bursts."""
    if per_minute <= 0:
        raise ValueError("a rate must be positive")
    return n * (60.0 / per_minute)


class Pacer:
    """Waits before each task of a driver loop so that they begin at least an interval apart."""

    def __init__(self, per_minute: float, clock: Callable[[], float], sleep: Callable[[float], None]):
        if per_minute <= 0:
            raise ValueError("a rate must be positive")
        self.interval, self.clock, self.sleep = 60.0 / per_minute, clock, sleep
        self.next = float("-inf")

    def wait(self) -> None:
        early = self.next - self.clock()
        if early > 0:
            self.sleep(early)
        self.next = self.clock() + self.interval
