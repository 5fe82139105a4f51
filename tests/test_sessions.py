"""Sessions, folds and windows against plain loops over one chat at a time."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from colloquy.operators import sessions

BIG = 9007199254740993  # not a float


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.fixture(scope="module")
def messages():
    rnd = random.Random(3)
    return [(rnd.choice([1, 2, 2, 2, None, BIG]), None if rnd.random() < 0.05 else rnd.randrange(500) * 1800, i) for i in range(600)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chat_id long, s long, message_id long").withColumn("sent_at", F.timestamp_seconds("s")).repartition(3)


def by_chat(rows):
    out = {}
    for c, t, i in rows:
        out.setdefault(c, []).append((t, i))
    return {c: in_order(v) for c, v in out.items()}


@pytest.mark.parametrize("hours", [5, 24])
def test_sessionize(spark, messages, hours):
    """Messages without a chat or a time stay."""
    want = {}
    for c, rows in by_chat(messages).items():
        n, before = 0, None
        for t, i in rows:
            n += before is not None and t is not None and t - before > 3 * 3600
            before, want[i] = t, (c, n)
    got = sessions.sessionize(frame(spark, messages), 3.0, bucket_hours=hours).collect()
    assert len(got) == len(messages) and {r["message_id"]: (r["chat_id"], r["session_no"]) for r in got} == want


def test_positions(spark, messages):
    want = {i: p for rows in by_chat(messages).values() for p, (_, i) in enumerate(rows)}
    assert {r["message_id"]: r["p"] for r in sessions.positioned(frame(spark, messages), ["chat_id"], "sent_at", "message_id", "p", 5).collect()} == want


def fold(costs, resets, most, budget):
    g, n, total, out = -1, 0, 0, []
    for j, (cost, reset) in enumerate(zip(costs, resets, strict=True)):
        if j == 0 or reset or n + 1 > most or total + cost > budget:
            g, n, total = g + 1, 0, 0
        n, total = n + 1, total + cost
        out.append(g)
    return out


@pytest.mark.parametrize(("most", "budget", "stretch"), [(4, 20, 7), (4, 20, 4), (1, 3, 5), (5, 1000, 16), (6, 0, 8), (3, 25, 4096)])
def test_split_capped(spark, most, budget, stretch):
    """Groups that span stretches of rows, and chats of many stretches."""
    rnd = random.Random(most * stretch)
    rows, want = [], {}
    for chat, n in ((1, 1), (None, 40), (BIG, 130)):
        costs, resets = [rnd.choice([0, 1, 5, 9, 30]) for _ in range(n)], [rnd.random() < 0.1 for _ in range(n)]
        for i, g in enumerate(fold(costs, resets, most, budget)):
            rows.append((chat, "x", i, costs[i], resets[i]))
            want[chat, i] = g
    df = spark.createDataFrame(rows, "chat_id long, z string, p long, cost long, r boolean").repartition(3)
    assert {(r["chat_id"], r["p"]): r["part"] for r in sessions.split_capped(df, ["chat_id", "z"], "p", "cost", most, budget, "r", stretch=stretch).collect()} == want
    assert sessions.split_capped(df.limit(0), ["chat_id"], "p", "cost", most, budget).count() == 0


def topics(texts, provider, topical_min, most, budget, window_tokens, overlap, least):
    n = len(texts)
    if n <= topical_min:
        return [0] * n, None
    costs = [-(-len(t or "") // 4) for t in texts]
    cuts, start = set(), 0
    while True:
        end, held = start, 0
        while end < n and (end == start or held + costs[end] <= window_tokens):
            held, end = held + costs[end], end + 1
        found = provider([t or "" for t in texts[start:end]])
        if any(not 0 < b < end - start for b in found):
            return [0] * n, "fallback:session"
        cuts |= {start + b for b in found}
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    starts = [0]
    for at in sorted(cuts):
        if at - starts[-1] >= least:
            starts.append(at)
    if len(starts) > 1 and n - starts[-1] < least:
        starts.pop()
    return fold(costs, [i in starts for i in range(n)], most, budget), None


@pytest.mark.parametrize(("window_tokens", "overlap", "least"), [(60, 3, 2), (10, 10, 3), (4000, 10, 2)])
def test_segment_sessions(spark, window_tokens, overlap, least):
    def provider(window):  # in here, so that it goes to the workers by value
        return [10**6] if any("BAD" in x for x in window) else [i for i in range(1, len(window)) if len(window[i]) % 5 == 0]

    rnd = random.Random(overlap)
    rows, want = [], {}
    for s in range(40):
        key, n = (rnd.choice([None, BIG, 7]), s), rnd.randrange(1, 60)
        texts = [rnd.choice([None, "", "x" * rnd.randrange(80)]) for _ in range(n)]
        if s % 9 == 0:
            texts[n // 2] = "BAD"
        groups, label = topics(texts, provider, 3, 6, 40, window_tokens, overlap, least)
        for i in range(n):
            rows.append((*key, i * 60, i, texts[i]))
            want[key, i] = groups[i], label
    df = spark.createDataFrame(rows, "chat_id long, session_no long, s long, message_id long, text string").withColumn("sent_at", F.timestamp_seconds("s")).repartition(3)
    done = sessions.segment_sessions(df, ["chat_id", "session_no"], ["sent_at", "message_id"], provider=provider, topical_min=3, most=6, budget=40, window_tokens=window_tokens, overlap=overlap, least=least)
    assert {((r["chat_id"], r["session_no"]), r["message_id"]): (r["seq_in_session"], r["topic_label"]) for r in done.collect()} == want


def test_failures_of_a_provider():
    calls = []

    def flaky(window):
        calls.append(1)
        if len(calls) == 1:
            raise sessions.BoundaryFailure
        return [5]

    def broken(window):
        raise KeyError("a mistake of the program")

    assert sessions.ask_boundaries(flaky, ["a"] * 10) == [5] and len(calls) == 2
    assert sessions.ask_boundaries(lambda w: [99], ["a"] * 10) is None
    with pytest.raises(KeyError):
        sessions.ask_boundaries(broken, ["a"])


def test_conversation_windows(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 2]), rnd.randrange(300) * 3600, i) for i in range(300)]
    asked = [(1, 50), (1, 51), (2, 0), (2, 400), (1, 50), (5, 3), (None, 4), (1, None)]
    anchors = spark.createDataFrame(asked, "chat_id long, x long").select("chat_id", F.timestamp_seconds(F.col("x") * 3600).alias("anchor_at"))
    got = sorted((r["chat_id"], r["x"], r["message_id"], r["offset"]) for r in sessions.conversation_windows(frame(spark, rows), anchors, 4).withColumn("x", F.unix_seconds("anchor_at")).collect())
    want = []
    for c, x in set(asked) - {(None, 4), (1, None)}:
        own = by_chat(rows).get(c, [])
        p = sum(t < x * 3600 for t, _ in own)
        want += [(c, x * 3600, i, j - p) for j, (_, i) in enumerate(own) if -4 <= j - p <= 4]
    assert got == sorted(want)


def test_workers_find_the_package(tmp_path, sf):
    """From another folder and without PYTHONPATH, by core operators alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {root!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("o06_link_preview", "o85_similar_people", "o108_chunks", "o144_rate_limit", "o61_token_windows", "o105_normalize"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert "done" in out.stdout, out.stderr[-3000:]
