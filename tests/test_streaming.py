"""Streams give what the batch forms give on the same input."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from colloquy.operators import incremental, queue, sessions
from colloquy.streaming import jobs


def drain(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, sf, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    shutil.copy(f"{sf}/events.parquet", folder / "a.parquet")
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(str(folder))


def test_sessions(spark, sf, tmp_path):
    got = drain(spark, jobs.stream_sessions(stream(spark, sf, tmp_path)), "sessions_out", "complete", tmp_path)
    batch = sessions.summarize_sessions(sessions.sessionize(spark.read.parquet(f"{sf}/events.parquet"), 3.0, "user_id", "ts", "event_id"), "user_id", "ts", "event_id")
    key = lambda df: sorted((r["user_id"], str(r["started_at"]), r["message_count"]) for r in df.collect())
    assert key(got) == key(batch)


def test_outbox(spark, sf, tmp_path):
    events = stream(spark, sf, tmp_path).select("event_id", F.lit("user").alias("entity_kind"), F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"))
    seen = {}
    jobs.consume_outbox(events, lambda df, n: seen.update({r["entity_id"]: (r["event_id"], r["operation"]) for r in df.collect()}), str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.lit("user").alias("entity_kind"), F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"))
    assert seen == {r["entity_id"]: (r["event_id"], r["operation"]) for r in incremental.last_events(rows).collect()}


def test_rate_limit(spark, sf, tmp_path):
    got = drain(spark, jobs.stream_rate_limit(stream(spark, sf, tmp_path), 2, 6 * 3600.0), "rates_out", "append", tmp_path)
    batch = queue.rate_limited(spark.read.parquet(f"{sf}/events.parquet"), 2, 6 * 3600.0)
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == {r["event_id"]: r["allowed"] for r in batch.collect()}


def replay(spark, rows, schema, folder, seed, batches=4):
    """A stream of the rows in some order, in several batches."""
    folder.mkdir(parents=True)
    mixed = rows[:]
    random.Random(seed).shuffle(mixed)
    for i in range(batches):
        part = spark.createDataFrame(mixed[i::batches], schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("seed", [1, 2])
def test_reactions_in_any_order(spark, tmp_path, rocks, seed):
    messages = [(f"g{i}", i) for i in range(30)] + [(None, 99)]
    reactions = [(f"g{i % 40}", 1000 + i) for i in range(60)] + [(None, 5000)]
    m = replay(spark, messages, "source_guid string, message_id long", tmp_path / "m", seed)
    r = replay(spark, reactions, "target_guid string, tapback_id long", tmp_path / "r", seed)
    got = drain(spark, jobs.stream_reactions(m, r), f"reactions_{seed}", "append", tmp_path).collect()
    batch = incremental.backfill_reactions(spark.createDataFrame([(t, g, None) for g, t in reactions], "tapback_id long, target_guid string, target_message_id long"), spark.createDataFrame(messages, "source_guid string, message_id long"))
    want = {(x["tapback_id"], x["target_message_id"]) for x in batch.where("target_message_id is not null").collect()}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_in_any_order(spark, tmp_path, rocks, seed):
    edits = [(i % 7, i * 1_000_000 % 13_000_000, f"v{i}") for i in range(60)] + [(3, 99_000_000, None), (None, 1, "x"), (1, None, "x")]
    rows = replay(spark, edits, "message_id long, t long, text string", tmp_path / "e", seed).withColumn("edited_at", F.timestamp_micros("t"))
    got = {}
    for x in drain(spark, jobs.stream_edits(rows), f"edits_{seed}", "update", tmp_path).collect():
        if x["edits"] > got.get(x["message_id"], (0,))[0]:
            got[x["message_id"]] = (x["edits"], x["edited_micros"], x["text"])
    want = {}
    for m in range(7):
        own = [(t, v is not None, v or "", v) for i, t, v in edits if i == m and t is not None]
        want[m] = (len(own), max(own)[0], max(own)[3])
    assert got == want


def test_watermarks_in_any_order(spark, tmp_path):
    rows = [(f"s{i % 3}", (i * 37) % 101) for i in range(50)] + [(None, 500)]
    got = drain(spark, jobs.stream_watermarks(replay(spark, rows, "source string, rowid long", tmp_path / "w", 1)), "marks", "complete", tmp_path)
    assert {tuple(r) for r in got.collect()} == {(f"s{j}", max(r for s, r in rows if s == f"s{j}")) for j in range(3)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_of_any_order(spark, sf, tmp_path, rocks, seed):
    """Events of a month in a random order, without a watermark: nothing is lost, and united sessions replace their parts."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id")
    rows = [tuple(r) for r in events.collect()][:400] + [(None, None, -1)]
    stream_ = replay(spark, rows, events.schema, tmp_path / "s", seed, batches=6)
    told = drain(spark, jobs.stream_sessions_kept(stream_, 3.0), f"kept_{seed}", "update", tmp_path).collect()
    now = {}
    for r in sorted(told, key=lambda r: r["message_count"]):  # of one session, the last row has most
        now[r["user_id"], r["started_at"]] = (r["ended_at"], r["message_count"])
    for r in told:
        for gone in r["replaces"]:
            now.pop((r["user_id"], gone), None)
    batch = sessions.summarize_sessions(sessions.sessionize(spark.createDataFrame(rows[:-1], events.schema), 3.0, "user_id", "ts", "event_id"), "user_id", "ts", "event_id")
    assert now == {(r["user_id"], r["started_at"]): (r["ended_at"], r["message_count"]) for r in batch.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "ended_at")}).collect()}
