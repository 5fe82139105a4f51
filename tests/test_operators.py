"""Worked cases of single operators."""

import datetime as dt
import hashlib
import json
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.functions import ids, text, times, vectors
from colloquy.operators import access, evaluation, identity, incremental, lexical, queue, ranking, rendering, segments, sessions
from colloquy.plans import upkeep
from colloquy.plans.search import SearchTables, hybrid_search
from colloquy.sources import extract, files, lint, records

T0 = dt.datetime(2024, 5, 1, 12, 0)


def one(spark, column, **values):
    """A column's value over one row of the given values."""
    values = values or {"_": 0}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


def messages(spark, minutes, chat=1):
    return spark.createDataFrame([(chat, i, T0 + dt.timedelta(minutes=m), f"g{i}") for i, m in enumerate(minutes)], "chat_id long, message_id long, sent_at timestamp_ntz, source_guid string")


def test_gap_equal_to_threshold_stays(spark):
    rows = sessions.sessionize(messages(spark, [0, 180, 361]), 3.0).orderBy("message_id").collect()
    assert [r["session_no"] for r in rows] == [0, 0, 1]


@pytest.mark.parametrize("gap", [179, 180, 181])
def test_incremental_equals_full(spark, gap):
    old = [0, 10, 400, 410, 900]
    base = sessions.summarize_sessions(sessions.sessionize(messages(spark, old), 3.0)).drop("session_no")
    allm = messages(spark, [*old, 900 + gap])
    change = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=900 + gap))], "chat_id long, changed_at timestamp_ntz")
    kept, rebuilt = upkeep.resegment(allm, base, change, 3.0)
    full = sessions.summarize_sessions(sessions.sessionize(allm, 3.0)).drop("session_no")
    assert sorted(map(tuple, kept.unionByName(rebuilt).collect())) == sorted(map(tuple, full.select(*base.columns).collect()))


def test_incremental_equals_full_at_random(spark):
    rnd = random.Random(5)
    for _ in range(3):
        minutes = sorted(rnd.sample(range(4000), 40))
        cut = rnd.randrange(5, 39)
        old, every = messages(spark, minutes).where(f"message_id <> {cut}"), messages(spark, minutes)
        base = sessions.summarize_sessions(sessions.sessionize(old, 3.0)).drop("session_no")
        change = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=minutes[cut]))], "chat_id long, changed_at timestamp_ntz")
        kept, rebuilt = upkeep.resegment(every, base, change, 3.0)
        full = sessions.summarize_sessions(sessions.sessionize(every, 3.0)).select(*base.columns)
        assert sorted(map(tuple, kept.unionByName(rebuilt).collect())) == sorted(map(tuple, full.collect()))


def test_normalize(spark):
    df = spark.createDataFrame([("don’t  “stop”️ now\n",), ("é",), (None,)], "t string")
    got = [r["n"] for r in df.select(text.normalize_text(F.col("t")).alias("n")).collect()]
    assert got == ["don't \"stop\" now", "é", None]
    again = df.select(text.normalize_text(text.normalize_text(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in again] == got
    assert lexical.normalize("don’t  “stop”️ now\n") == got[0]


def test_chunks():
    assert text.chunks_of("") == [] and text.chunks_of("  a. b. ") == ["a.\n\nb."]
    paragraphs = "\n\n".join(f"p{i} " + "x" * 396 for i in range(40))
    chunks = text.chunks_of(paragraphs)
    assert len(chunks) > 1 and all(-(-len(c) // 4) <= 1700 for c in chunks)
    assert chunks[1].split("\n\n")[0] == chunks[0].split("\n\n")[-1]
    assert [len(c) for c in text.chunks_of("y" * 13000)] == [6000, 6000, 1000]


def test_snippets_and_symbols(spark):
    df = spark.createDataFrame([("  abc def ",), ("",), (None,), (" ",)], "t string")
    assert [r[0] for r in df.select(text.snippet(F.col("t"), 4)).collect()] == ["abc…", "—", "—", "—"]
    df = spark.createDataFrame([("emoji:🎉",), ("liked",), ("odd",)], "k string")
    assert [r[0] for r in df.select(text.reaction_symbol(F.col("k"))).collect()] == ["🎉", "👍", "odd"]


def test_routing():
    assert lexical.route('"exact phrase"').mode == "trigram" and lexical.route('"ab"').phrase == "ab" and lexical.route('"ab"').mode == "bm25"
    assert lexical.route("party 🎉").mode == "emoji" and lexical.route('say "hi" now').mode == "bm25"
    assert lexical.like_pattern("50%_a\\b") == "%50\\%\\_a\\\\b%"
    assert lexical.query_phrases("don't STOP") == [["don", "t"], ["stop"]]


def test_bm25_phrases_and_apostrophes(spark):
    docs = spark.createDataFrame([(1, "I don't know"), (2, "t don know"), (3, "don t"), (4, "nothing here"), (5, None)], "segment_id long, text string")
    assert {r["segment_id"] for r in lexical.bm25(docs, "don't").collect()} == {1, 3}
    assert lexical.bm25(docs, "").count() == 0
    assert [r["segment_id"] for r in lexical.substring_hits(docs, "othing HE").collect()] == [4]


def test_routes_in_columns(spark):
    asked = ['"exact phrase"', '"ab"', "party 🎉", 'say "hi" now', '""', '"', "", "  spaced   out ", '“curly one”', '"  abc "', '"🎉🎉🎉"', "a️b"]
    mode, phrase = lexical.route_columns(F.col("q"))
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", mode.alias("m"), phrase.alias("p")).collect()
    assert [(r["m"], r["p"]) for r in rows] == [(lexical.route(q).mode, lexical.route(q).phrase) for q in asked]


def test_index_gives_what_a_scan_gives(spark, tmp_path):
    rnd = random.Random(4)
    words = ["don't", "stop", "the", "music", "naïve", "STOP", "a-b", "x"]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(12)))) for i in range(300)] + [(300, None), (301, "")], "segment_id long, text string")
    index = lexical.write_index(docs, str(tmp_path / "index"), position=7)
    assert (index.n_docs, index.position) == (302, 7) and lexical.open_index(spark, str(tmp_path / "index")).n_postings == index.n_postings
    for asked in ("stop", "don't stop", "NAIVE music", "a-b the", "absent stop", "", "stop stop"):
        want = {r["segment_id"]: r["score"] for r in lexical.bm25(docs, asked).collect()}
        assert {r["segment_id"]: r["score"] for r in index.search(asked).collect()} == {k: pytest.approx(v) for k, v in want.items()}
    assert "regexp_extract_all" not in index.search("stop")._jdf.queryExecution().toString()


def test_index_versions(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    with pytest.raises(lexical.StaleIndex):
        lexical.open_index(spark, folder)
    docs = spark.createDataFrame([(1, "old words")], "segment_id long, text string")
    lexical.write_index(docs, folder)
    lexical.write_index(docs.withColumn("text", F.lit("new words")), folder, position=3)
    now = lexical.open_index(spark, folder)
    assert now.position == 3 and now.search("new").count() == 1 and now.search("old").count() == 0
    empty = lexical.write_index(docs.limit(0), folder)
    assert empty.n_docs == 0 and empty.search("new").count() == 0
    monkeypatch.setitem(lexical.TOKENIZERS, "word", "another")
    with pytest.raises(lexical.StaleIndex):
        lexical.open_index(spark, folder)


def places(text, phrase):
    return sum(text.startswith(phrase, i) for i in range(len(text)))


def test_trigram_index(spark, tmp_path):
    """Hits, ranks and counts of phrases, also of those that overlap themselves, as a scan gives them."""
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice("abA é🎉") for _ in range(rnd.choice([0, 1, 2, 3, 60])))) for i in range(200)] + [(200, None), (201, "aaaa aaaa")]
    docs = spark.createDataFrame(rows, "segment_id long, text string")
    index = lexical.write_index(docs, str(tmp_path / "index"), kind="trigram")
    assert index.n_docs == 202 and index.n_terms == sum(max(len(t or "") - 2, 0) for _, t in rows)
    for asked in ("aba", "abab", "aaa", "a é", "ÉA", "b🎉", "aab ab", "no such", "ab"):
        got = {r["segment_id"]: r["score"] for r in index.search(asked).collect()}
        assert set(got) == ({i for i, t in rows if asked.lower() in (t or "").lower()} if len(asked) > 2 else set())
        if len(asked) > 2:
            assert got == {r["segment_id"]: pytest.approx(r["score"]) for r in lexical.bm25_of_phrase(docs, asked).collect()}
    one, three = (r["score"] for r in lexical.bm25_of_phrase(spark.createDataFrame([(1, "xyz " + "_" * 20), (2, "xyz xyz xyz " + "_" * 12), *[(i, "_" * 24) for i in range(3, 9)]], "segment_id long, text string"), "xyz").orderBy("segment_id").collect())
    assert one < three
    plan = index.search("aab ab")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan


@pytest.mark.parametrize("kind", ["word", "trigram"])
def test_index_after_events_is_a_rebuilt_one(spark, tmp_path, kind):
    rnd = random.Random(6)
    words = ["alpha", "beta", "gamma", "Alpha beta", "delta"]
    text_of = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))
    now = {i: text_of() for i in range(40)}
    schema = "segment_id long, text string"
    index = lexical.write_index(spark.createDataFrame(list(now.items()), schema), str(tmp_path / "index"), position=10, kind=kind)
    events, number = [(3, 1, "delete"), (10, 2, "delete")], 10  # both applied already
    for last in (False, True):
        for _ in range(15):
            key, number = rnd.randrange(50), number + 1
            if rnd.random() < 0.3:
                now.pop(key, None)
                events.append((number, key, rnd.choice(["delete", "upsert"])))  # an upsert whose content is gone
            else:
                now[key] = text_of()
                events.append((number, key, "upsert"))
        content = spark.createDataFrame(list(now.items()), schema)
        shuffled = rnd.sample(events, len(events))
        index = lexical.apply_events(index, spark.createDataFrame(shuffled, "event_id long, segment_id long, operation string"), content)
        again = lexical.write_index(content, str(tmp_path / f"whole{number}"), kind=kind)
        opened = lexical.open_index(spark, str(tmp_path / "index"), kind)
        for at in (opened, lexical.compact(replace(index, folder=str(tmp_path / "compact")))) if last else (index,):
            assert (at.n_docs, at.n_terms, at.n_postings, at.position) == (again.n_docs, again.n_terms, again.n_postings, number)
            for asked in ("alpha beta", "gamma"):
                assert {r["segment_id"]: r["score"] for r in at.search(asked).collect()} == {r["segment_id"]: pytest.approx(r["score"]) for r in again.search(asked).collect()}
    assert lexical.apply_events(index, spark.createDataFrame(events, "event_id long, segment_id long, operation string"), content) is index  # nothing new
    with pytest.raises(lexical.StaleIndex):
        lexical.open_index(spark, str(tmp_path / "index"), kind, source="other files")


def test_index_is_made_in_pieces(spark, tmp_path, monkeypatch):
    """A batch of any size is worked on a piece at a time; a row of a piece holds all postings of a bucket."""
    monkeypatch.setattr(lexical, "PIECE_BYTES", 100)
    texts = ["some words and others " * 3] * 40 + [None, "", "x" * 500]
    for source in (pa.array(texts), pa.array([(t or "").split() for t in texts])):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), source], ["segment_id", "terms"])
        parts = list(lexical._pieces(batch))
        assert len(parts) > 20 and sum(p.num_rows for p in parts) == len(texts) and all(p.num_rows < 5 for p in parts)
    x = np.array([0, 3, 70_000, 1])
    assert lexical._unpack(lexical._pack(x)).tolist() == x.tolist() and len(lexical._unpack(lexical._pack(x[:0]))) == 0
    docs = spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string").coalesce(1)
    index = lexical.write_index(docs, str(tmp_path / "index"), kind="trigram")
    assert index._stored.where("terms is not null").count() < index.n_postings / 5
    found = {r["term"]: (r["df"], r["cf"]) for r in index.terms.collect()}
    assert found["xxx"] == (1, 498) and found["me "] == (40, 120)


def test_phrases_are_counted_in_one_pass(spark):
    """No list of places is made for a text, and signs of regular expressions stand for themselves."""
    texts = ["a.b a.b axb a.b", "a.b" * 3, "(a+b) [c] (a+b)", "aaaa", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "segment_id long, text string")
    for phrase in ("a.b", "(a+b)", "[c]", "aa"):
        got = lexical.bm25_of_phrase(docs, phrase)
        assert {r["segment_id"] for r in got.collect()} == {i for i, t in enumerate(texts) if phrase in t}
        assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    long = spark.createDataFrame([(1, "aaaa" + "_" * 8), (2, "aa" + "_" * 10), *[(i, "_" * 12) for i in range(3, 9)]], "segment_id long, text string")
    four, two = (r["score"] for r in lexical.bm25_of_phrase(long, "aa").orderBy("segment_id").collect())
    assert four / two == pytest.approx((3 * 2.2 / (3 + 1.2)) / (2.2 / (1 + 1.2)))


def test_requests_are_dealt_twice(spark):
    """By what they ask for, and by their anchors; not again for what their chats add."""
    chats = spark.createDataFrame([(1, "t1"), (2, "t2")], "chat_id long, thread_key string")
    told = spark.createDataFrame([(1, "s1", T0), (1, "s2", T0 + dt.timedelta(days=1))], "chat_id long, stable_key string, started_at timestamp")
    messages = spark.createDataFrame([(1, "m1", T0 + dt.timedelta(hours=1))], "chat_id long, message_key string, sent_at timestamp")
    asked = spark.createDataFrame([("a", "s1", None), ("b", "t1", None), ("c", "t1", "m1"), ("d", "t2", None), ("e", "t2", "m1"), ("f", "no", None)], "request_id string, thread_id string, anchor string")
    got = segments.resolve_anchors(asked.hint("merge"), told.hint("merge"), chats.hint("merge"), messages.hint("merge"))
    rows = {r["request_id"]: (r["chat_id"], r["thread_key"], r["anchor_at"], r["error"]) for r in got.collect()}
    assert rows == {
        "a": (1, "t1", T0, None), "b": (1, "t1", T0 + dt.timedelta(days=1), None), "c": (1, "t1", T0 + dt.timedelta(hours=1), None),
        "d": (2, "t2", None, "no_segments"), "e": (2, "t2", None, "bad_anchor"), "f": (None, None, None, "not_found"),
    }
    above = [line for line in segments.resolve_anchors(asked, told, chats, messages)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and len(line) - len(line.lstrip(" :+-")) <= 8]
    assert "anchor" in above[0]  # the last join is that of the anchors


def test_rrf(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 3), ("a", 2, 2)], "channel string, segment_id long, rank int")
    got = {r["segment_id"]: r["score"] for r in ranking.fuse(rows).collect()}
    assert got == pytest.approx({1: 1 / 61 + 1 / 63, 2: 1 / 62})


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", s, i + 1) for i, s in enumerate("abcd")] + [("z", "a", 1), ("n", "a", 1)], "query_id string, segment_id string, rank int")
    grades = spark.createDataFrame([("q", "a", 2), ("q", "c", 1), ("z", "a", 0)], "query_id string, segment_id string, grade int")
    queries = spark.createDataFrame([("q",), ("z",), ("n",), ("none",)], "query_id string")
    got = {r["query_id"]: r for r in evaluation.query_metrics(queries, ranked, grades, 4).collect()}
    assert got["q"]["ndcg"] == pytest.approx(0.96394043) and got["q"]["recall"] == 1.0 and got["q"]["rr"] == 1.0 and got["q"]["judged"] == 2
    assert got["z"]["ndcg"] is None and got["z"]["recall"] is None and got["z"]["rr"] == 0.0 and not got["z"]["success"]
    assert got["n"]["ndcg"] is None and got["none"]["window_size"] == 0
    total = evaluation.roll_up(evaluation.query_metrics(queries, ranked, grades, 4)).first()
    assert total["mrr"] == 0.25 and total["scored_queries"] == 1 and total["judged_coverage"] == 0.5


def test_access_context():
    with pytest.raises(access.InvalidArgument):
        access.AccessContext("local", "allowlist")
    with pytest.raises(access.InvalidArgument):
        access.Filters(after="2024-02-01", before="2024-01-01")
    with pytest.raises(access.InvalidArgument):
        access.Filters(people=tuple(range(21)))


def test_eligibility_matrix(spark):
    chats = spark.createDataFrame([(i,) for i in range(1, 5)], "chat_id long")
    people = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, None)], "chat_id long, person_id long")
    allow = spark.createDataFrame([(10, True), (11, None)], "person_id long, text_allowed boolean")
    out = access.eligible_chats(chats, people, {"not_allowed": access.not_allowed(people, allow)})
    got = {r["chat_id"]: (r["eligible"], r["reasons"]) for r in out.collect()}
    loose = spark.createDataFrame([(None, True), (1, True), (2, True), (2, None), (3, None)], "person_id long, text_allowed boolean")
    asked = spark.createDataFrame([(p,) for p in (None, 1, 2, 3, 4)], "person_id long")
    assert {r[0] for r in access.not_allowed(asked, loose).collect()} == {None, 2, 3, 4}  # an entry without a person allows nobody, a second one can deny
    assert got == {1: (True, []), 2: (False, ["not_allowed"]), 3: (False, ["no_participants", "not_allowed"]), 4: (False, ["no_participants"])}
    scoped = access.scoped_chats(chats, people.where("person_id is not null"), allow, access.AccessContext("public", "allowlist"))
    assert {r[0] for r in scoped.collect()} == {1, 3, 4}  # no participants pass a search, not an export


def test_attachment_gate(spark):
    rows = spark.createDataFrame([(1, 5, True, False), (1, 5, False, False), (1, 6, True, False), (1, 6, False, True), (1, 7, None, False)], "segment_id long, attachment_id long, allowed boolean, is_unsent boolean")
    assert {r["attachment_id"]: r["content_eligible"] for r in access.attachment_gate(rows).collect()} == {5: False, 6: True, 7: False}


def test_outbox(spark):
    index = spark.createDataFrame([(1, "old"), (2, "old")], "entity_id long, text string")
    content = spark.createDataFrame([(1, "new"), (3, "three")], "entity_id long, text string")
    events = [(1, 1, "upsert"), (2, 2, "delete"), (3, 3, "delete"), (4, 3, "upsert"), (5, 4, "upsert"), (0, 1, "delete")]
    want = {1: "new", 3: "three"}
    for seed in range(3):
        random.Random(seed).shuffle(events)
        after, told = incremental.apply_outbox(index, spark.createDataFrame(events, "event_id long, entity_id long, operation string"), content, -1)
        assert {r["entity_id"]: r["text"] for r in after.collect()} == want
        assert {r["entity_id"]: r["outcome"] for r in told.collect()} == {1: "applied", 2: "deleted", 3: "applied", 4: "skipped"}


def test_queue(spark):
    now = F.lit(T0).cast("timestamp_ntz")
    q = spark.createDataFrame(
        [(1, "ocr", "pending", 0, T0, None, None), (2, "ocr", "running", 0, T0, T0 - dt.timedelta(hours=1), "w"), (3, "ocr", "running", 2, T0, T0, "w"), (4, "ocr", "pending", 0, T0 + dt.timedelta(1), None, None)],
        "attachment_id long, kind string, state string, attempts int, next_attempt_at timestamp_ntz, locked_at timestamp_ntz, locked_by string",
    )
    assert {r["attachment_id"] for r in queue.claim(q, now, 10, "me").collect()} == {1, 2}
    results = spark.createDataFrame([(1, "ocr", "error"), (3, "ocr", "error")], "attachment_id long, kind string, outcome string")
    got = {r["attachment_id"]: r for r in queue.settle(q, results, now, 3).collect()}
    assert got[1]["state"] == "pending" and got[1]["next_attempt_at"] == T0 + dt.timedelta(seconds=60) and got[3]["state"] == "failed" and got[3]["locked_by"] is None and got[2]["locked_by"] == "w"
    asked = [(key, T0 + dt.timedelta(seconds=s), 10 * i + s % 7) for i, key in enumerate((None, 9007199254740993)) for s in (0, 1, 2, 60, 61)]
    told = queue.rate_limited(spark.createDataFrame(asked, "user_id long, ts timestamp_ntz, event_id long"), 2, 60.0).orderBy("user_id", "ts").collect()
    assert [(r["user_id"], r["allowed"]) for r in told] == [(key, ok) for key in (None, 9007199254740993) for ok in (True, True, False, True, True)]


def test_rendering(spark):
    df = spark.createDataFrame([(T0, "anna", "hi", ["[image]"], ["old"], ["♥ bob"])], "at timestamp_ntz, s string, t string, a array<string>, h array<string>, r array<string>")
    line = rendering.message_line(F.col("at"), F.col("s"), F.col("t"), F.col("a"), F.col("h"), F.col("r"), "America/New_York")
    assert df.select(line).first()[0] == '[08:00] anna: hi [image] [edited from: "old"] ♥ bob'
    head = rendering.header(F.array(F.lit("Anna")), F.lit("group"), F.lit("Trip"), F.col("at"), F.col("at") + F.expr("interval 1 day"))
    assert df.select(head).first()[0] == 'Chat: Anna (group "Trip")\nTime: 2024-05-01 12:00 – 2024-05-02 12:00 UTC'
    doc = df.select(rendering.sample_lines(F.lit("h\n---\na\nb\n\nc\nd\n"))).first()[0]
    assert doc == ["a", "c", "d"]
    none = F.lit(None).cast("string")
    pdf = rendering.attachment_text(F.lit("application/pdf"), F.lit("a.pdf"), F.lit("k"), F.lit("body"), none, none, none, 10)
    held = rendering.attachment_text(F.lit("image/png"), none, F.lit("k"), none, none, none, none, 10, export=True, eligible=F.lit(False))
    assert list(df.select(pdf, held).first()) == ['[pdf "a.pdf": "body" — full text via get_attachment_text("k")]', rendering.WITHHELD]


def test_people(spark):
    people = spark.createDataFrame([(1, "anna", "Anna Smith"), (2, "anna-2", "Anna Smith"), (3, "bob", "Bob Jones")], "person_id long, short_name string, display_name string")
    assert identity.resolve_person(people, "anna")[0] == "found"
    assert identity.resolve_person(people, "Anna Smith")[0] == "ambiguous"
    outcome, near = identity.resolve_person(people, "Bob Jonse")
    assert outcome == "ambiguous" and near.first()["short_name"] == "bob"
    assert identity.resolve_person(people, "zzzzqqq")[0] == "not_found"
    with pytest.raises(ValueError):
        identity.resolve_person(people, " ")
    names = identity.short_names(people.drop("short_name"))
    assert [r["short_name"] for r in names.orderBy("person_id").collect()] == ["anna-smith", "anna-smith-2", "bob-jones"]
    with pytest.raises(RuntimeError):
        identity.require_clean(spark.createDataFrame([(0, 2)], "messages_without_sender long, owners long"))


def test_handles(spark):
    df = spark.createDataFrame([(" Anna@X.org ",), ("(202) 555-0101",), ("+49 30 1234567",), ("hello",)], "h string")
    kind, value = text.normalize_handle(F.col("h"))
    assert [tuple(r) for r in df.select(kind, value).collect()] == [("email", "anna@x.org"), ("phone", "+12025550101"), ("phone", "+49301234567"), ("unknown", "hello")]


def test_ids(spark):
    assert one(spark, ids.derived_key("message", F.col("g")), g="abc") == hashlib.sha256(b"message:abc").hexdigest()
    assert ids.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}' and ids.canonical_json({"a": "é"}, ascii_only=False) == '{"a":"é"}'
    base = dict(session_gap_hours=3.0, topical_min_messages=6, max_messages=50, max_tokens=3000, boundary_model="m", boundary_prompt=b"p", index_unsent=False, index_edit_history=True)
    assert ids.segmentation_config_hash(**base) != ids.segmentation_config_hash(**base | {"session_gap_hours": 3.5})
    with pytest.raises(Exception, match="empty source guid"):
        one(spark, ids.derived_key("message", F.col("g")), g="")


def test_times(spark):
    assert one(spark, times.from_apple_ns(F.col("v")).cast("string"), v=1_000_000_000) == "2001-01-01 00:00:01"
    assert one(spark, times.from_apple_ns(F.col("v")), v=0) is None
    assert one(spark, times.slots("01:00-02:00")) == [60, 90, 120]
    with pytest.raises(Exception, match="bad window"):
        one(spark, times.slots(F.col("w")), w="22:00-02:00")


def test_vectors(spark):
    v, again, other = (one(spark, vectors.fake_embedding(F.col("t"), 20), t=t) for t in ("doc:x", "doc:x", "doc:y"))
    assert sum(x * x for x in v) == pytest.approx(1.0) and v == again != other
    assert one(spark, vectors.from_literal(vectors.to_literal(F.array(F.lit(0.1), F.lit(-2.0))))) == [0.1, -2.0]
    assert all(one(spark, vectors.from_literal(F.col("t")), t=t) is None for t in ("[1,x]", "1,2", "[1,2", "[[1]]"))
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [3.0, 4.0])], "k string, vec array<double>")
    assert {r["k"]: r["vec"] for r in vectors.mean_vectors(rows, ["k"]).collect()} == {"a": pytest.approx([2**-0.5, 2**-0.5]), "b": pytest.approx([0.6, 0.8])}
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    row = df.select(vectors.cosine_distance(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("z")), vectors.mean_of(F.array("a", "b"))).first()
    assert row[0] == pytest.approx(1.0) and row[1] is None and row[2] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_search_is_not_starved(spark):
    segs = spark.createDataFrame([(i, i % 50, f"apple pie {'apple ' * (i % 7)}", T0) for i in range(400)], "segment_id long, chat_id long, text string, started_at timestamp_ntz")
    vecs = spark.createDataFrame([(i, [1.0, i / 400]) for i in range(400)], "segment_id long, vec array<double>")
    people = spark.createDataFrame([(c, 1 if c == 49 else 2) for c in range(50)], "chat_id long, person_id long")
    allow = spark.createDataFrame([(1, True), (2, False)], "person_id long, text_allowed boolean")
    tables = SearchTables(segs, vecs, participants=people, allowlist=allow)
    got = hybrid_search(tables, "apple", [1.0, 0.0], context=access.AccessContext("public", "allowlist"), limit=10, k=20).collect()
    assert len(got) == 8 and all(r["segment_id"] % 50 == 49 for r in got)
    with pytest.raises(ValueError):
        hybrid_search(tables, " ", [1.0, 0.0])


def test_a_filter_does_not_change_scores(spark, tmp_path):
    texts = ["apple pie", "apple", "pie crust", "pear", "plum", "fig"]
    segs = spark.createDataFrame([(i, i % 2, t, T0 + dt.timedelta(days=i)) for i, t in enumerate(texts * 3)], "segment_id long, chat_id long, text string, started_at timestamp_ntz")
    vecs = spark.createDataFrame([(i, [1.0, i / 9]) for i in range(18)], "segment_id long, vec array<double>")
    for index in (None, lexical.write_index(segs, str(tmp_path / "i"))):
        tables = SearchTables(segs, vecs.limit(0), text_index=index)
        ranks = {r["segment_id"]: r["rank"] for r in hybrid_search(tables, "apple", [1.0, 0.0], limit=50).collect()}
        some = {r["segment_id"]: r["rank"] for r in hybrid_search(tables, "apple", [1.0, 0.0], filters=access.Filters(extra=(F.col("chat_id") == 1,)), limit=50).collect()}
        assert set(ranks) == {0, 1, 6, 7, 12, 13} and set(some) == {1, 7, 13} and sorted(some, key=some.get) == sorted(some, key=ranks.get)


def test_link_preview_root(spark):
    import plistlib

    objects = ["$null", {"URL": "https://lost.example/"}, {"metadata": plistlib.UID(3)}, {"originalURL": {"NS.relative": plistlib.UID(4)}, "title": "T"}, "https://found.example/"]
    blob = plistlib.dumps({"$objects": objects, "$top": {"root": plistlib.UID(2)}}, fmt=plistlib.FMT_BINARY)
    bare = plistlib.dumps({"URL": "https://bare.example/"}, fmt=plistlib.FMT_BINARY)
    df = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(bare))], "i int, p binary").select("i", records.link_preview(F.col("p")).alias("r"))
    got = {r["i"]: r["r"] for r in df.collect()}
    assert (got[1]["url"], got[1]["title"]) == ("https://found.example/", "T") and got[2] is None


def test_extraction(spark, tmp_path):
    import sys

    pages = "\f".join(["page one has some sixty characters of text in it, all in all.", "page two"]) + "\f"
    for name, body in (("a.txt", pages), ("empty.txt", " \f"), ("b.txt", "x")):
        (tmp_path / name).write_text(body)
    cat = lambda p: [sys.executable, "-c", "import sys; sys.stdout.write(open(sys.argv[1]).read())", p]
    slow, bad = (lambda p: ["sleep", "9"]), (lambda p: ["false"])
    tasks = spark.createDataFrame([(1, "pdf_text", str(tmp_path / "a.txt")), (2, "pdf_text", str(tmp_path / "empty.txt")), (3, "caption", str(tmp_path / "b.txt")), (4, "ocr", str(tmp_path / "b.txt")), (5, "transcript", str(tmp_path / "b.txt")), (6, "frame_ocr", str(tmp_path / "b.txt")), (7, "pdf_text", str(tmp_path / "none"))], "attachment_id long, kind string, path string")
    done = extract.extract(tasks, {"pdf_text": cat, "ocr": slow, "transcript": bad, "frame_ocr": lambda p: ["no-such-program"]}, extract.Limits(seconds=1.0))
    got = {r["attachment_id"]: r for r in done.collect()}
    assert {i: got[i]["outcome"] for i in got} == {1: "done", 2: "skipped", 3: "failed", 4: "retry", 5: "retry", 6: "failed", 7: "retry"}
    assert extract.pages_of(got[1]["text"])[1] == "page two" and not extract.is_scanned(["x" * 60]) and extract.is_scanned([])
    assert {r["attachment_id"] for r in extract.follow_ups(done).collect()} == {1, 2}
    assert extract.extract_one(str(tmp_path / "a.txt"), "pdf_text", {"pdf_text": cat}, extract.Limits(pages=1))[2] == "too many pages"
    assert extract.extract_one(str(tmp_path / "a.txt"), "pdf_text", {"pdf_text": cat}, extract.Limits(file_bytes=5))[0] == "failed"
    assert extract.sniff(b"%PDF-1.7", "image/png") == "application/pdf" and extract.sniff(b"....ftypisom", None) == "video/mp4" and extract.sniff(b"", "a/b") == "a/b"
    flags = spark.createDataFrame([(5, 0, "-"), (5, 8, "dataless,x"), (0, 0, None), (None, None, None)], "size long, blocks long, flags string")
    assert [r[0] for r in flags.select(extract.dataless(F.col("size"), F.col("blocks"), F.col("flags"))).collect()] == [True, True, False, False]


def test_snapshots_are_checked(tmp_path):
    import sqlite3

    live = tmp_path / "live.db"
    with sqlite3.connect(live) as db:
        db.execute("CREATE TABLE message (x)")
        db.executemany("INSERT INTO message VALUES (?)", [(i,) for i in range(5000)])
    files.backup(live, tmp_path / "copy.db")
    files.check_snapshot(tmp_path / "copy.db", ["message"])
    with pytest.raises(ValueError, match="lacks"):
        files.check_snapshot(tmp_path / "copy.db", ["message", "chat"])
    data = bytearray((tmp_path / "copy.db").read_bytes())
    data[4096:9000] = b"x" * 4904
    (tmp_path / "bad.db").write_bytes(data)
    with pytest.raises(ValueError):
        files.check_snapshot(tmp_path / "bad.db", ["message"])


def test_vector_lint():
    good = "CREATE TABLE s (id bigint, vec halfvec(2048) NOT NULL); -- vec vector(9000)\nCREATE INDEX i ON s USING hnsw (vec halfvec_cosine_ops);"
    assert lint.lint_vectors({"1.sql": good}) == []
    bad = {"1.sql": "create table a (v vector(2001), w halfvec(10), note text default 'x vector(3)');", "2.sql": "CREATE INDEX ON a USING ivfflat (w halfvec_l2_ops); ALTER TABLE a ADD COLUMN u vector(8);"}
    assert [f.split(": ", 1)[1][:20] for f in lint.lint_vectors(bad)] == ["a.u has no index", "a.v has 2001 dimensi", "a.v has no index", "a.w is indexed by ha"]


def test_verdicts_and_pacing(spark):
    now, asked = [0.0], []

    def ask(name):
        asked.append(name)
        if name == "down":
            raise OSError
        return name == "good", 300.0

    cache = queue.VerdictCache(ask, lambda: now[0])
    assert cache.verdict("good") and not cache.verdict("bad") and cache.verdict("good") and asked == ["good", "bad"]
    now[0] = 61.0
    assert not cache.verdict("bad") and asked[2:] == ["bad"] and cache.verdict("good")
    assert not cache.verdict("down") and not cache.verdict("other") and asked[3:] == ["down"]
    now[0] = 67.0
    assert not cache.verdict("other") and asked[4:] == ["other"]
    slept = []
    clock = [0.0]
    pacer = queue.Pacer(60, lambda: clock[0], slept.append)
    for step in (0.0, 0.25, 3.0):
        clock[0] = step
        pacer.wait()
    assert slept == [0.75] and one(spark, queue.paced(F.lit(3), 120)) == 1.5
    with pytest.raises(ValueError):
        queue.Pacer(0, lambda: 0.0, slept.append)


def test_staged_documents_are_hashed_in_place(spark, tmp_path):
    staged = files.stage_documents(tmp_path / "run", {"d1": "text", "d2": "more", "d3": "x"}, {})
    (staged / "docs" / "d2.txt").write_text("changed")
    (staged / "docs" / "d3.txt").unlink()
    (staged / "docs" / "d4.txt").write_text("stray")
    assert {r["id"]: r["verified"] for r in files.verified_frame(spark, str(staged)).collect()} == {"d1": True, "d2": False, "d3": False, "d4": False}


def test_config_hashes(spark):
    fields = dict(session_gap_hours=3.0, topical_min_messages=6, max_messages=50, max_tokens=3000, boundary_model="m", boundary_prompt=b"p", index_unsent=False, index_edit_history=True)
    names = {"session_gap_hours": "3.0", "topical_min_messages": "6", "max_messages": "50", "max_tokens": "3000", "boundary_model": "m", "boundary_prompt_sha256": hashlib.sha256(b"p").hexdigest(), "index_unsent": "False", "index_edit_history": "True", "renderer_version": "1", "boundary_window_tokens": "4000", "boundary_window_overlap_messages": "10", "min_messages_per_segment": "2"}
    assert one(spark, ids.config_hash(names)) == ids.segmentation_config_hash(**fields)
    assert ids.projected_hash({"a": {"b": 1, "c": 2}, "d": 3}, ["a.b", "x.y"]) == ids.canonical_hash({"a.b": 1, "x.y": None})


def test_rerender_keeps_what_it_does_not_change(spark):
    segs = spark.createDataFrame([(1, "k1", "old", "h"), (2, "k2", "old", "h"), (3, "k3", "old", "h")], "segment_id long, stable_key string, rendered_text string, rendered_sha256 string")
    lines = spark.createDataFrame([(1, 1, 10, "a"), (2, 1, 11, "b")], "segment_id long, sent_at int, message_id long, line string")
    heads = spark.createDataFrame([(1, "H"), (2, "H"), (3, "H")], "segment_id long, head string")
    affected = spark.createDataFrame([(1,), (3,)], "segment_id long")
    after, events = segments.rerender(segs, affected, lines, heads)
    assert {r["segment_id"]: r["rendered_text"] for r in after.collect()} == {1: "H\n---\na", 2: "old", 3: "old"} and after.columns == segs.columns
    assert [r["entity_id"] for r in events.collect()] == [1]
    assert segments.rerender(after, affected, lines, heads)[1].count() == 0


def test_message_records(spark, tmp_path):
    good = {"rowid": 1, "guid": "g", "is_from_me": True, "edit_history": [{"text": "a", "edited_at": None}], "attachment_rowids": [3]}
    (tmp_path / "a.ndjson").write_text(json.dumps(good) + "\n")
    assert records.read_messages(spark, str(tmp_path / "a.ndjson")).first()["attachment_rowids"] == [3]
    for i, bad in enumerate(('{"rowid": "x", "guid": "g", "is_from_me": true}', '{"rowid": 1, "is_from_me": true}')):
        (tmp_path / f"b{i}.ndjson").write_text(bad + "\n")
        with pytest.raises(Exception):
            records.read_messages(spark, str(tmp_path / f"b{i}.ndjson")).collect()
    assert one(spark, records.link_preview(F.col("p").cast("binary")), p="not a plist") is None


def test_files(tmp_path):
    src = tmp_path / "a.bin"
    src.write_bytes(b"data")
    place, new = files.store_by_content(src, tmp_path / "root")
    assert new and place.read_bytes() == b"data" and files.store_by_content(src, tmp_path / "root")[1] is False
    assert files.snapshot(src, tmp_path / "snap")[1] and not files.snapshot(src, tmp_path / "snap")[1]
    staged = files.stage_documents(tmp_path / "run1", {"d1": "text", "d2": "more"}, {"upserts": 2})
    assert files.verify_staged(staged) == []
    (staged / "docs" / "d2.txt").write_text("changed")
    assert files.verify_staged(staged) == ["d2"]
    with pytest.raises(FileExistsError):
        files.stage_documents(tmp_path / "run1", {}, {})
    files.write_run(tmp_path / "run.json", {"run_id": "a", "per_query": []})
    assert files.read_run(tmp_path / "run.json") == {"run_id": "a", "per_query": []}
    assert files.seed_from_json(files.seed_to_json(["b", "a", "a"])) == {"guids": ["a", "b"]}
    rows = [{"id": "q1", "query": "ça: va?", "targets": ["local"]}, {"id": "q2", "query": "x", "targets": []}]
    assert files.rows_from_yaml(files.rows_to_yaml(rows)) == rows
    assert files.report_csv({"a": (["x"], [[1]]), "b": (["y"], [])}) == "# a\nx\n1\n\n# b\ny\n"
    hub = files.MemoryTransport()
    hub.upload("segments/d1.txt", b"t")
    hub.import_documents({"d1": "t"})
    hub.delete("d1")
    assert hub.is_absent("d1") and not hub.objects
    files.swap_pointer(tmp_path, "v2")
    assert (tmp_path / "current").read_text() == "v2"


def test_export_plan(spark):
    docs = spark.createDataFrame([("d1", 1, "p1", "pdf", "h1"), ("d2", 2, "p2", "pdf", "h2"), ("d3", 3, "p1", "png", "h3")], "document_id string, chat_id long, person string, mime_type string, content_sha256 string")
    eligible = spark.createDataFrame([(1, True), (2, False), (3, True)], "chat_id long, eligible boolean")
    pushed = docs.where("document_id <> 'd3'")
    first = upkeep.plan_export(docs, eligible, pushed, {"a": 1}, None)
    assert first.reasons == ("first_push",)
    plan = upkeep.plan_export(docs, eligible, pushed, {"a": 1}, first.config_sha256)
    assert {r["document_id"]: r["action"] for r in plan.actions.collect()} == {"d1": "unchanged", "d2": "delete", "d3": "upsert"}
    assert plan.reasons == ("deletes", "new_thread", "new_mime_type")
    assert upkeep.plan_export(docs, eligible, pushed, {"a": 1}, first.config_sha256, "purge").reasons == ()
    changed = docs.withColumn("content_sha256", F.when(F.col("document_id") == "d1", "x").otherwise(F.col("content_sha256")))
    assert [r[0] for r in upkeep.drifted(docs, changed).collect()] == ["d1"]


def test_sync_stops_at_dirty_identity(spark):
    clean = spark.createDataFrame([(0, 1)], "messages_without_sender long, owners long")
    assert upkeep.sync(["a"], lambda s: None, lambda: clean, lambda: None, lambda: None) == ["extract:a", "segment", "index"]
    with pytest.raises(RuntimeError):
        upkeep.sync(["a"], lambda s: None, lambda: clean.withColumn("owners", F.lit(0)), lambda: None, lambda: None)
    tried = []

    def extract_source(name):
        tried.append(name)
        if name == "a":
            raise OSError("gone")

    with pytest.raises(RuntimeError, match="sources failed"):
        upkeep.sync(["a", "b"], extract_source, lambda: clean, lambda: None, lambda: None)
    assert tried == ["a", "b"] and upkeep.sync(["a"], extract_source, None, None, None, dry_run=True) == ["extract:a", "segment", "index"]


def test_variants_and_cap():
    assert evaluation.variants(["rerank", "multimodal"])[-1] == {"rerank": True, "multimodal": True}
    assert ranking.scan_cap(5) == 200 and ranking.cap_flag(3, 200, 5, 200) and not ranking.cap_flag(5, 200, 5, 200)
