"""Queries over messages, sessions, chats and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import ids, text, times
from colloquy.operators import access, evaluation, identity, incremental, lexical, queue, rendering, segments, sessions
from colloquy.plans import upkeep
from colloquy.plans.views import register, sql, view
from colloquy.session import shared_path
from colloquy.sources import records

GAP = "epoch_us(sent_at) - epoch_us(lag(sent_at) OVER w) > 10800000000"
SESSIONS = f"""s AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY sent_at, message_id ROWS UNBOUNDED PRECEDING) AS session_no
  FROM (SELECT *, coalesce({GAP}, false) AS brk FROM message WINDOW w AS (PARTITION BY chat_id ORDER BY sent_at, message_id))),
ss AS (SELECT chat_id, CAST(session_no AS BIGINT) AS session_no, min(sent_at) AS started_at, max(sent_at) AS ended_at, count(*) AS message_count, arg_min(message_id, (sent_at, message_id)) AS first_message, arg_max(message_id, (sent_at, message_id)) AS last_message FROM s GROUP BY ALL)"""


def _sessions(spark, sf):
    return sessions.sessionize(view(spark, sf, "message"), 3.0)


def _summaries(spark, sf):
    return sessions.summarize_sessions(_sessions(spark, sf))


@register("o60_sessionize", sql("SELECT message_id, chat_id, CAST(session_no AS BIGINT) AS session_no FROM s", "message", ctes=SESSIONS))
def o60(spark, sf):
    return _sessions(spark, sf).select("message_id", "chat_id", "session_no")


@register("o60_sessionize_split", sql("SELECT message_id, chat_id, CAST(session_no AS BIGINT) AS session_no FROM s", "message", ctes=SESSIONS))
def o60b(spark, sf):
    return sessions.sessionize(view(spark, sf, "message"), 3.0, bucket_hours=5).select("message_id", "chat_id", "session_no")


@register("o66_session_summary", sql("SELECT * FROM ss", "message", ctes=SESSIONS))
def o66(spark, sf):
    return _summaries(spark, sf)


@register("o02_chats_with_participants", sql("SELECT chat_id, status, (SELECT count(*) FROM line WHERE line.chat_id = chat.chat_id) AS participants FROM chat", "chat", "line"))
def o02(spark, sf):
    counts = view(spark, sf, "line").groupBy("chat_id").agg(F.count("*").alias("participants"))
    return view(spark, sf, "chat").join(counts, "chat_id", "left").select("chat_id", "status", F.coalesce("participants", F.lit(0)).alias("participants"))


@register("o03_incremental_scan", sql("""SELECT message_id, chat_id FROM message WHERE message_id > (SELECT CAST(floor(max(message_id) * 0.9) AS BIGINT) FROM message) OR coalesce(CASE WHEN is_unsent THEN sent_at END > TIMESTAMP '2024-01-20', false) OR coalesce(CASE WHEN kind = 'signup' THEN sent_at END > TIMESTAMP '2024-01-25', false)""", "message"))
def o03(spark, sf):
    m = view(spark, sf, "message")
    watermark = m.agg(F.floor(F.max("message_id") * 0.9)).first()[0] or 0
    m = m.withColumn("retracted_at", F.when(F.col("is_unsent"), F.col("sent_at"))).withColumn("edited_at", F.when(F.col("kind") == "signup", F.col("sent_at") - F.expr("INTERVAL 5 DAYS")))
    return incremental.incremental_scan(m, watermark, F.lit("2024-01-20").cast("timestamp_ntz"), "message_id").select("message_id", "chat_id")


@register("o03_first_chat", sql("SELECT supplier_id AS message_id, min(chat_id) AS chat_id FROM line GROUP BY 1", "line"))
def o03b(spark, sf):
    return incremental.first_chat(view(spark, sf, "line").select(F.col("supplier_id").alias("message_id"), "chat_id"))


@register("o04_attachment_scan", sql("SELECT chat_id, attachment_id, row_number() OVER (PARTITION BY chat_id ORDER BY attachment_id, ordinal) - 1 AS position FROM line WHERE chat_id IN (SELECT chat_id FROM chat WHERE status = 'F')", "line", "chat"))
def o04(spark, sf):
    wanted = view(spark, sf, "line").join(view(spark, sf, "chat").where("status = 'F'"), "chat_id", "left_semi")
    return incremental.numbered(wanted, ["chat_id"], ["attachment_id", "ordinal"], "position").select("chat_id", "attachment_id", F.col("position").cast("long").alias("position"))


@register("o05_json_decode", sql("SELECT message_id, CAST(json_extract(text, '$.k') AS BIGINT) AS k FROM message", "message"))
def o05(spark, sf):
    return view(spark, sf, "message").select("message_id", F.from_json("text", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@register("o05_strict_decode", sql("""SELECT message_id, CASE kind WHEN 'click' THEN message_id WHEN 'purchase' THEN message_id END AS rowid, CASE kind WHEN 'click' THEN source_guid WHEN 'purchase' THEN source_guid END AS guid,
  CASE kind WHEN 'click' THEN len(text) WHEN 'purchase' THEN 0 END AS n_ids, CASE kind WHEN 'click' THEN 'added' END AS action, CASE kind WHEN 'view' THEN 'not_json' WHEN 'error' THEN 'type:rowid' WHEN 'signup' THEN 'missing:guid' END AS problem,
  CASE WHEN kind = 'purchase' THEN 'extra' ELSE '' END AS unknown FROM message""", "message"))
def o05b(spark, sf):
    m = view(spark, sf, "message")
    lines = {
        "click": F.format_string('{"rowid": %d, "guid": "%s", "tapback": {"kind": "loved", "target_guid": "t"}, "attachment_rowids": [%s]}', "message_id", "source_guid", F.array_join(F.sequence(F.lit(1), F.length("text")), ",")),
        "purchase": F.format_string('{"guid": "%s", "extra": {"a": [1]}, "rowid": %d, "service": null}', "source_guid", "message_id"),
        "error": F.format_string('{"rowid": "%d", "guid": "%s"}', "message_id", "source_guid"), "signup": F.format_string('{"rowid": %d}', "message_id"), "view": F.format_string('{"rowid": %d, "guid": "%s"', "message_id", "source_guid"),
    }
    line = F.lit(None).cast("string")
    for kind, text_of in lines.items():
        line = F.when(F.col("kind") == kind, text_of).otherwise(line)
    done = records.decode_lines(m.select("message_id", line.alias("line")))
    return done.select("message_id", "rowid", "guid", F.when(F.col("rowid").isNotNull(), F.size("attachment_rowids")).cast("long").alias("n_ids"), "tapback.action", "problem", F.array_join("unknown_fields", ",").alias("unknown"))


@register("o06_link_preview", sql("SELECT page_id, url, 'Page ' || page_id AS title FROM page", "page"))
def o06(spark, sf):
    import plistlib

    @F.udf("binary", useArrow=True)
    def archive(url: str, title: str) -> bytes:
        return plistlib.dumps({"$objects": ["$null", {"URL": plistlib.UID(2), "title": title}, {"NS.relative": url}], "$top": {"root": plistlib.UID(1)}}, fmt=plistlib.FMT_BINARY)

    p = view(spark, sf, "page").withColumn("payload", archive("url", F.concat(F.lit("Page "), F.col("page_id").cast("string"))))
    return p.select("page_id", records.link_preview(F.col("payload")).alias("p")).select("page_id", "p.url", "p.title")


@register("o21_date_range", sql("SELECT message_id FROM message WHERE sent_at >= TIMESTAMP '2024-01-10 05:00:00' AND sent_at < TIMESTAMP '2024-01-12 05:00:00'", "message"))
def o21(spark, sf):
    return view(spark, sf, "message").where(access.in_dates(F.col("sent_at"), "2024-01-10", "2024-01-12", "America/New_York")).select("message_id")


@register("o22_has_attachment", sql("SELECT chat_id, session_no FROM ss WHERE EXISTS (SELECT 1 FROM s WHERE s.chat_id = ss.chat_id AND s.session_no = ss.session_no AND has_attachments)", "message", ctes=SESSIONS))
def o22(spark, sf):
    s = _sessions(spark, sf)
    return _summaries(spark, sf).join(s.where("has_attachments").select("chat_id", "session_no"), ["chat_id", "session_no"], "left_semi").select("chat_id", "session_no")


@register("o22_has_no_attachment", sql("SELECT chat_id, session_no FROM ss WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.chat_id = ss.chat_id AND s.session_no = ss.session_no AND has_attachments)", "message", ctes=SESSIONS))
def o22b(spark, sf):
    s = _sessions(spark, sf)
    return _summaries(spark, sf).join(s.where("has_attachments").select("chat_id", "session_no"), ["chat_id", "session_no"], "left_anti").select("chat_id", "session_no")


@register("o23_people_division", sql("SELECT chat_id FROM line WHERE supplier_id IN (1, 2, 3, 4, 5) GROUP BY chat_id HAVING count(DISTINCT CASE WHEN supplier_id IN (1, 2) THEN supplier_id END) = 2", "line"))
def o23(spark, sf):
    return access.with_all_people(view(spark, sf, "line").withColumnRenamed("supplier_id", "person_id"), (1, 2))


PARTICIPANTS = "participant AS (SELECT chat_id, person_id FROM direct UNION SELECT chat_id, supplier_id AS person_id FROM line WHERE flag = 'R')"


def _participants(spark, sf):
    return view(spark, sf, "direct").union(view(spark, sf, "line").where("flag = 'R'").select("chat_id", "supplier_id")).distinct()


@register("o24_scope_eligible", sql("SELECT chat_id FROM chat WHERE NOT EXISTS (SELECT 1 FROM participant p WHERE p.chat_id = chat.chat_id AND NOT EXISTS (SELECT 1 FROM allowlist a WHERE a.person_id = p.person_id AND a.text_allowed))", "chat", "direct", "line", "allowlist", ctes=PARTICIPANTS))
def o24(spark, sf):
    return access.scoped_chats(view(spark, sf, "chat"), _participants(spark, sf), view(spark, sf, "allowlist"), access.AccessContext("public", "allowlist"))


@register("o20_compiled_predicate", sql("""SELECT chat_id AS segment_id FROM chat WHERE started_at >= TIMESTAMP '1996-01-01' AND started_at < TIMESTAMP '1999-01-01'
  AND NOT EXISTS (SELECT 1 FROM direct p LEFT JOIN allowlist a USING (person_id) WHERE p.chat_id = chat.chat_id AND NOT coalesce(a.text_allowed, false))
  AND EXISTS (SELECT 1 FROM line WHERE line.chat_id = chat.chat_id AND flag = 'R')""", "chat", "direct", "line", "allowlist"))
def o20(spark, sf):
    chats = view(spark, sf, "chat").withColumn("segment_id", F.col("chat_id"))
    filters = access.Filters(after="1996-01-01", before="1999-01-01", has_attachment=True)
    with_files = view(spark, sf, "line").where("flag = 'R'").select(F.col("chat_id").alias("segment_id"))
    return access.visible_segments(chats, filters, access.AccessContext("public", "allowlist"), participants=view(spark, sf, "direct"), allowlist=view(spark, sf, "allowlist"), with_attachments=with_files)


@register("o26_literal_like", sql("SELECT person_id FROM person WHERE contains(replace(display_name, '#', '%_'), '%_0000000')", "person"))
def o26(spark, sf):
    named = view(spark, sf, "person").withColumn("name", F.replace("display_name", F.lit("#"), F.lit("%_")))
    return named.where(F.col("name").like(lexical.like_pattern("%_0000000"))).select("person_id")


@register("o27_ilike", sql("SELECT person_id, short_name FROM person WHERE display_name ILIKE '%R#0000001_%' OR short_name ILIKE '%R#0000001_%'", "person"))
def o27(spark, sf):
    p = view(spark, sf, "person")
    return p.where(F.col("display_name").ilike("%R#0000001_%") | F.col("short_name").ilike("%R#0000001_%")).select("person_id", "short_name")


@register("o31_chat_kind", sql("SELECT chat_id, CASE WHEN priority = '1-URGENT' THEN 'group' WHEN priority = '5-LOW' THEN 'dm' WHEN n > 1 THEN 'group' ELSE 'dm' END AS kind FROM chat LEFT JOIN (SELECT chat_id, count(DISTINCT supplier_id) AS n FROM line GROUP BY 1) USING (chat_id)", "chat", "line"))
def o31(spark, sf):
    n = view(spark, sf, "line").groupBy("chat_id").agg(F.countDistinct("supplier_id").alias("n"))
    style = F.when(F.col("priority") == "1-URGENT", 43).when(F.col("priority") == "5-LOW", 45)
    return view(spark, sf, "chat").join(n, "chat_id", "left").select("chat_id", records.chat_kind(style, F.col("n")).alias("kind"))


@register("o32_service", sql("SELECT message_id, CASE WHEN kind = 'click' THEN 'imessage' WHEN kind = 'view' THEN 'sms' ELSE 'unknown' END AS service FROM message", "message"))
def o32(spark, sf):
    raw = F.when(F.col("kind") == "click", " iMessage ").when(F.col("kind") == "view", "SMS").otherwise(F.col("kind"))
    return view(spark, sf, "message").select("message_id", records.service_name(raw).alias("service"))


@register("o33_effective_sender", sql("SELECT message_id, coalesce(sender_person_id, CASE WHEN is_from_me THEN 0 END) AS sender FROM message", "message"))
def o33(spark, sf):
    return view(spark, sf, "message").select("message_id", access.effective_sender(F.col("sender_person_id"), F.col("is_from_me"), 0).cast("long").alias("sender"))


@register("o36_unsegmented", sql("SELECT segment_id FROM segment WHERE NOT EXISTS (SELECT 1 FROM vector v WHERE v.segment_id = segment.segment_id)", "segment", "vector"))
def o36(spark, sf):
    return incremental.absent(view(spark, sf, "segment"), view(spark, sf, "vector"), "segment_id").select("segment_id")


@register("o37_in_list", sql("SELECT message_id FROM message WHERE chat_id IN (SELECT person_id FROM person WHERE segment = 'MACHINERY')", "message", "person"))
def o37(spark, sf):
    return view(spark, sf, "message").join(view(spark, sf, "person").where("segment = 'MACHINERY'").select(F.col("person_id").alias("chat_id")), "chat_id", "left_semi").select("message_id")


@register("o38_update_from", sql("SELECT message_id, coalesce(sender_person_id, p.person_id) AS sender_person_id FROM message LEFT JOIN (SELECT person_id, person_id + 1 AS chat_id FROM person) p USING (chat_id)", "message", "person"))
def o38(spark, sf):
    return incremental.fill_from(view(spark, sf, "message"), view(spark, sf, "person").select((F.col("person_id") + 1).alias("chat_id"), "person_id"), "chat_id", "sender_person_id", "person_id").select("message_id", "sender_person_id")


@register("o39_computed_key_join", sql("SELECT message_id, p.display_name FROM message JOIN person p ON p.person_id = coalesce(sender_person_id, CASE WHEN is_from_me THEN 0 END)", "message", "person"))
def o39(spark, sf):
    m = view(spark, sf, "message").withColumn("person_id", access.effective_sender(F.col("sender_person_id"), F.col("is_from_me"), 0))
    return m.join(view(spark, sf, "person"), "person_id").select("message_id", "display_name")


@register("o40_null_denies", sql("SELECT DISTINCT chat_id FROM participant p LEFT JOIN allowlist a USING (person_id) WHERE NOT coalesce(a.text_allowed, false)", "direct", "line", "allowlist", ctes=PARTICIPANTS))
def o40(spark, sf):
    return access.not_allowed(_participants(spark, sf), view(spark, sf, "allowlist")).select("chat_id").distinct()


@register("o43_unique_match", sql("SELECT translate(short_name, '1', '2') AS key, min(display_name) AS contact FROM person GROUP BY 1 HAVING count(DISTINCT display_name) = 1 AND key IN (SELECT short_name FROM person)", "person"))
def o43(spark, sf):
    p = view(spark, sf, "person")
    contacts = p.select(F.translate("short_name", "1", "2").alias("key"), F.col("display_name").alias("contact"))
    return identity.unique_match(p.select(F.col("short_name").alias("key")), contacts, "key", "contact")


@register("o44_list_people", sql("SELECT p.person_id, short_name, display_name, count(m.message_id) AS message_count, min(m.sent_at) AS first_at, max(m.sent_at) AS last_at FROM person p LEFT JOIN message m ON m.sender_person_id = p.person_id WHERE display_name ILIKE '%customer#%' OR short_name ILIKE '%customer#%' GROUP BY ALL ORDER BY message_count DESC, short_name LIMIT 500", "person", "message"))
def o44(spark, sf):
    return identity.list_people(view(spark, sf, "person"), view(spark, sf, "message"), "customer#", 500)


EVIDENCE = """denied AS (SELECT DISTINCT p.chat_id, 'participant_not_allowed' AS reason FROM direct p LEFT JOIN allowlist a USING (person_id) WHERE NOT coalesce(a.text_allowed, false)
  UNION SELECT DISTINCT chat_id, 'returned' FROM line WHERE flag = 'R' UNION SELECT DISTINCT chat_id, 'pending' FROM chat WHERE status = 'P')"""


@register("o46_chat_eligibility", sql("""SELECT c.chat_id, coalesce(n, 0) AS participant_count, array_to_string(list_sort(list_concat(coalesce(r, []), CASE WHEN coalesce(n, 0) = 0 THEN ['no_participants'] ELSE [] END)), ',') AS reasons,
  coalesce(len(r), 0) = 0 AND coalesce(n, 0) > 0 AS eligible FROM chat c LEFT JOIN (SELECT chat_id, count(DISTINCT person_id) AS n FROM recipient WHERE priority <> '5-LOW' GROUP BY 1) USING (chat_id) LEFT JOIN (SELECT chat_id, list(reason) AS r FROM denied GROUP BY 1) USING (chat_id)""", "chat", "direct", "recipient", "line", "allowlist", ctes=EVIDENCE))
def o46(spark, sf):
    direct, chats = view(spark, sf, "direct"), view(spark, sf, "chat")
    evidence = {"participant_not_allowed": access.not_allowed(direct, view(spark, sf, "allowlist")), "returned": view(spark, sf, "line").where("flag = 'R'"), "pending": chats.where("status = 'P'")}
    out = access.eligible_chats(chats, view(spark, sf, "recipient").where("priority <> '5-LOW'"), evidence)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@register("o47_dirty_chats", sql("SELECT chat_id, min(e) AS earliest FROM (SELECT chat_id, min(sent_at) AS e FROM message WHERE kind = 'signup' GROUP BY 1 UNION ALL SELECT chat_id, min(sent_at) FROM message WHERE sent_at > TIMESTAMP '2024-01-25' GROUP BY 1) GROUP BY 1", "message"))
def o47(spark, sf):
    m = view(spark, sf, "message")
    return incremental.dirty_chats(m.where("kind = 'signup'"), m.where("sent_at > TIMESTAMP_NTZ '2024-01-25'"))


@register("o48_seed_counts", sql("SELECT year(started_at) AS year, count(*) AS n, count(DISTINCT person_id) AS people FROM chat JOIN direct USING (chat_id) GROUP BY 1", "chat", "direct"))
def o48(spark, sf):
    return view(spark, sf, "chat").join(view(spark, sf, "direct"), "chat_id").groupBy(F.year("started_at").cast("long").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("people"))


@register("o56_invariants", sql("SELECT (SELECT count(*) FROM message WHERE sender_person_id IS NULL AND NOT is_from_me) AS messages_without_sender, (SELECT count(*) FROM person WHERE is_owner) AS owners, (SELECT count(*) FROM line WHERE supplier_id IS NULL) AS handles_without_person, (SELECT count(*) FROM direct d WHERE NOT EXISTS (SELECT 1 FROM person p WHERE p.person_id = d.person_id)) AS participants_without_person", "message", "person", "line", "direct"))
def o56(spark, sf):
    return identity.invariants(view(spark, sf, "message"), view(spark, sf, "person"), view(spark, sf, "line").withColumnRenamed("supplier_id", "person_id"), view(spark, sf, "direct"))


@register("o57_last_ok_run", sql("SELECT chat_id, max(sent_at) AS last_ok, max(message_id) AS run_id FROM message WHERE NOT is_unsent GROUP BY 1", "message"))
def o57(spark, sf):
    runs = view(spark, sf, "message").select("chat_id", F.col("message_id").alias("run_id"), F.col("sent_at").alias("finished_at"), (~F.col("is_unsent")).alias("ok"))
    return incremental.last_ok_runs(runs, "chat_id")


@register("o59_foreign_audit", sql("SELECT count(*) AS accepted_foreign FROM message WHERE kind <> 'view' AND NOT is_unsent AND sender_person_id <> 3", "message"))
def o59(spark, sf):
    audit = view(spark, sf, "message").select(F.col("sender_person_id").cast("string").alias("subject"), (~F.col("is_unsent")).alias("subject_ok"), F.when(F.col("kind") == "view", "local").otherwise("public").alias("surface"))
    return access.accepted_foreign(audit, "3")


TOPICS = SESSIONS + """, t AS (SELECT chat_id, CAST(session_no AS BIGINT) AS session_no, message_id, row_number() OVER (PARTITION BY chat_id, session_no ORDER BY sent_at, message_id) - 1 AS i, count(*) OVER (PARTITION BY chat_id, session_no) AS n FROM s)"""


@register("o65_segment_sessions", sql("""SELECT chat_id, session_no, message_id, CASE WHEN n <= 6 THEN 0 ELSE least(i // 5, (n - CASE WHEN n % 5 = 1 THEN 2 ELSE 1 END) // 5) END AS seq_in_session, CAST(NULL AS VARCHAR) AS topic_label FROM t""", "message", ctes=TOPICS))
def o65(spark, sf):
    done = sessions.segment_sessions(_sessions(spark, sf), ["chat_id", "session_no"], ["sent_at", "message_id"])
    return done.select("chat_id", "session_no", "message_id", F.col("seq_in_session").cast("long").alias("seq_in_session"), "topic_label")


def topic_ctes(rows: str, window_tokens: int, overlap: int, least: int = 2, most: int = 50, budget: int = 3000, topical_min: int = 0) -> str:
    """Windows, boundaries, starts and groups of the rows ``(chat_id, sent_at, message_id, text)`` of a relation, a step of each at a time."""
    return f"""t AS (SELECT chat_id, sent_at, message_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY chat_id) AS n FROM {rows} WINDOW o AS (PARTITION BY chat_id ORDER BY sent_at, message_id)),
p AS (SELECT *, sum(cost) OVER (PARTITION BY chat_id ORDER BY i) AS upto FROM t WHERE n > {topical_min}),
ends AS (SELECT a.chat_id, a.i AS s, a.n, greatest(a.i + 1, count(*) FILTER (b.upto <= a.upto - a.cost + {window_tokens})) AS e FROM p a JOIN p b ON a.chat_id = b.chat_id GROUP BY a.chat_id, a.i, a.n, a.upto, a.cost),
ws AS (SELECT chat_id, CAST(0 AS BIGINT) AS s FROM p WHERE i = 0 UNION ALL SELECT ws.chat_id, greatest(e - {overlap}, ws.s + 1) FROM ws JOIN ends USING (chat_id, s) WHERE e < n),
win AS (SELECT chat_id, s, e, n FROM ws JOIN ends USING (chat_id, s)),
bound AS (SELECT DISTINCT chat_id, n, s + unnest(range(5, e - s, 5)) AS pl FROM win),
nextb AS (SELECT a.chat_id, a.pl, min(b.pl) AS nxt FROM (SELECT chat_id, pl FROM bound UNION SELECT chat_id, 0 FROM win) a JOIN bound b ON b.chat_id = a.chat_id AND b.pl >= a.pl + {least} GROUP BY a.chat_id, a.pl),
walk AS (SELECT chat_id, nxt AS pl FROM nextb WHERE pl = 0 UNION ALL SELECT w.chat_id, x.nxt FROM walk w JOIN nextb x ON x.chat_id = w.chat_id AND x.pl = w.pl),
begins AS (SELECT DISTINCT w.chat_id, w.pl FROM walk w JOIN bound b ON b.chat_id = w.chat_id AND b.pl = w.pl WHERE b.n - w.pl >= {least}),
r AS (SELECT p.*, b.pl IS NOT NULL AS fresh FROM p LEFT JOIN begins b ON b.chat_id = p.chat_id AND b.pl = p.i),
folded AS (SELECT chat_id, i, CAST(0 AS BIGINT) AS g, CAST(1 AS BIGINT) AS k, cost AS total FROM r WHERE i = 0
  UNION ALL SELECT r.chat_id, r.i, CASE WHEN r.fresh OR f.k + 1 > {most} OR f.total + r.cost > {budget} THEN f.g + 1 ELSE f.g END, CASE WHEN r.fresh OR f.k + 1 > {most} OR f.total + r.cost > {budget} THEN 1 ELSE f.k + 1 END,
  CASE WHEN r.fresh OR f.k + 1 > {most} OR f.total + r.cost > {budget} THEN r.cost ELSE f.total + r.cost END FROM folded f JOIN r ON r.chat_id = f.chat_id AND r.i = f.i + 1)"""


@register("o61_o63_topics_of_conversations", sql("SELECT t.chat_id, t.sent_at, t.message_id, coalesce(g, 0) AS seq_in_session, CAST(NULL AS VARCHAR) AS topic_label FROM t LEFT JOIN folded USING (chat_id, i)", "turn", ctes=topic_ctes("turn", 4000, 10, most=4, budget=600, topical_min=3)))
def o61(spark, sf):
    done = sessions.segment_sessions(view(spark, sf, "turn"), ["chat_id"], ["sent_at", "message_id"], topical_min=3, most=4, budget=600)
    return done.withColumn("seq_in_session", F.col("seq_in_session").cast("long"))


def _placed(spark, sf):
    return sessions.positioned(view(spark, sf, "message"), ["chat_id"], "sent_at", "message_id", "place")


def _windows(spark, sf):
    """Windows over whole chats, small enough that a chat has several."""
    return sessions.topic_windows(_placed(spark, sf), ["chat_id"], "place", window_tokens=40, overlap=4)


CHAT_TOPICS = topic_ctes("message", 40, 4, least=3, most=4, budget=12)


@register("o61_token_windows", sql('SELECT chat_id, s AS start, e AS "end" FROM win', "message", ctes=CHAT_TOPICS))
def o61b(spark, sf):
    return _windows(spark, sf).select("_k.chat_id", "start", "end")


@register("o62_boundary_merge", sql('SELECT chat_id, pl AS "at" FROM bound', "message", ctes=CHAT_TOPICS))
def o62(spark, sf):
    return _windows(spark, sf).select("_k.chat_id", F.explode("cuts").alias("at")).distinct()


@register("o63_topic_starts", sql('SELECT chat_id, pl AS "at" FROM begins', "message", ctes=CHAT_TOPICS))
def o63(spark, sf):
    return sessions.topic_starts(_windows(spark, sf), least=3).select("_k.chat_id", "at")


@register("o65_topics_of_chats", sql("SELECT chat_id, message_id, g AS seq_in_session FROM folded JOIN p USING (chat_id, i)", "message", ctes=CHAT_TOPICS))
def o65b(spark, sf):
    done = sessions.segment_sessions(view(spark, sf, "message"), ["chat_id"], ["sent_at", "message_id"], topical_min=0, most=4, budget=12, window_tokens=40, overlap=4, least=3)
    return done.select("chat_id", "message_id", F.col("seq_in_session").cast("long").alias("seq_in_session"))


@register("o64_hard_split", sql("""SELECT chat_id, message_id, g AS part FROM folded""", "turn", ctes="""t AS (SELECT chat_id, message_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY chat_id ORDER BY message_id) AS rn FROM turn),
folded AS (SELECT chat_id, message_id, rn, CAST(0 AS BIGINT) AS g, CAST(1 AS BIGINT) AS n, cost AS total FROM t WHERE rn = 1
  UNION ALL SELECT t.chat_id, t.message_id, t.rn, CASE WHEN f.n + 1 > 4 OR f.total + t.cost > 600 THEN f.g + 1 ELSE f.g END, CASE WHEN f.n + 1 > 4 OR f.total + t.cost > 600 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n + 1 > 4 OR f.total + t.cost > 600 THEN t.cost ELSE f.total + t.cost END
  FROM folded f JOIN t ON t.chat_id = f.chat_id AND t.rn = f.rn + 1)"""))
def o64(spark, sf):
    rows = view(spark, sf, "turn").withColumn("cost", text.estimate_tokens(F.col("text")))
    placed = sessions.positioned(rows, ["chat_id"], "sent_at", "message_id", "place")
    return sessions.split_capped(placed, ["chat_id"], "place", "cost", 4, 600).select("chat_id", "message_id", F.col("part").cast("long").alias("part"))


@register("o67_edit_history", sql("SELECT chat_id, message_id, row_number() OVER (PARTITION BY chat_id ORDER BY sent_at, message_id) - 1 AS version_idx FROM message WHERE kind = 'click'", "message"))
def o67(spark, sf):
    out = incremental.numbered(view(spark, sf, "message").where("kind = 'click'"), ["chat_id"], ["sent_at", "message_id"], "version_idx")
    return out.select("chat_id", "message_id", F.col("version_idx").cast("long").alias("version_idx"))


@register("o68_attachment_ordinal", sql("SELECT chat_id, attachment_id, ordinal, row_number() OVER (PARTITION BY chat_id ORDER BY ordinal, attachment_id, quantity) - 1 AS position FROM line", "line"))
def o68(spark, sf):
    out = incremental.numbered(view(spark, sf, "line"), ["chat_id"], ["ordinal", "attachment_id", "quantity"], "position")
    return out.select("chat_id", "attachment_id", "ordinal", F.col("position").cast("long").alias("position"))


@register("o69_latest_start", sql("SELECT chat_id, max(started_at) AS latest FROM ss GROUP BY 1", "message", ctes=SESSIONS))
def o69(spark, sf):
    return _summaries(spark, sf).groupBy("chat_id").agg(F.max("started_at").alias("latest"))


@register("o70_label_anchor", sql("SELECT chat_id, CAST(session_no AS BIGINT) AS session_no, arg_min(source_guid, (sent_at, message_id)) AS anchor_guid FROM s GROUP BY 1, 2", "message", ctes=SESSIONS))
def o70(spark, sf):
    s = _sessions(spark, sf).withColumn("segment_id", F.struct("chat_id", "session_no"))
    return sessions.first_message(s).select("segment_id.chat_id", "segment_id.session_no", "anchor_guid")


@register("o71_conversation_window", sql("""SELECT m.chat_id, m.message_id, CAST(CASE WHEN m.sent_at < a.anchor_at THEN -row_number() OVER (PARTITION BY m.chat_id, m.sent_at < a.anchor_at ORDER BY CASE WHEN m.sent_at < a.anchor_at THEN epoch_us(m.sent_at) END DESC, CASE WHEN m.sent_at < a.anchor_at THEN m.message_id END DESC)
  ELSE row_number() OVER (PARTITION BY m.chat_id, m.sent_at < a.anchor_at ORDER BY m.sent_at, m.message_id) - 1 END AS BIGINT) AS offset_no FROM message m JOIN (SELECT chat_id, TIMESTAMP '2024-01-15' AS anchor_at FROM message GROUP BY 1) a USING (chat_id) QUALIFY offset_no BETWEEN -5 AND 5""", "message"))
def o71(spark, sf):
    m = view(spark, sf, "message")
    anchors = m.select("chat_id", F.lit("2024-01-15").cast("timestamp_ntz").alias("anchor_at")).distinct()
    return sessions.conversation_windows(m, anchors, 5).select("chat_id", "message_id", F.col("offset").cast("long").alias("offset_no"))


ANCHORED = SESSIONS + """, members AS (SELECT message_id, chat_id || '-' || CAST(session_no AS BIGINT) AS segment_id FROM s WHERE kind <> 'signup'),
lab AS (SELECT chat_id AS query_id, CASE WHEN kind = 'error' THEN 'x' || source_guid WHEN kind = 'view' THEN NULL ELSE source_guid END AS anchor_guid, CAST(floor(value) AS INTEGER) % 3 AS grade FROM message),
found AS (SELECT query_id, grade, m.segment_id FROM lab LEFT JOIN (SELECT source_guid, segment_id FROM message JOIN members USING (message_id)) m ON m.source_guid = lab.anchor_guid)"""


def _resolved_labels(spark, sf):
    s = _sessions(spark, sf)
    members = s.where("kind <> 'signup'").select("message_id", F.concat_ws("-", F.col("chat_id").cast("string"), F.col("session_no").cast("string")).alias("segment_id"))
    anchor = F.expr("CASE WHEN kind = 'error' THEN concat('x', source_guid) WHEN kind = 'view' THEN NULL ELSE source_guid END")
    labels = s.select(F.col("chat_id").alias("query_id"), anchor.alias("anchor_guid"), F.expr("cast(floor(value) as int) % 3").alias("grade"))
    return evaluation.resolve_labels(labels, view(spark, sf, "message"), members)


@register("o53_resolved_grades", sql("SELECT query_id, segment_id, max(grade) AS grade FROM found WHERE segment_id IS NOT NULL GROUP BY ALL", "message", ctes=ANCHORED))
def o53b(spark, sf):
    return _resolved_labels(spark, sf)[0]


@register("o53_unresolved_labels", sql("SELECT query_id, count(*) AS labels, count(*) FILTER (segment_id IS NULL) AS unresolved FROM found GROUP BY 1", "message", ctes=ANCHORED))
def o53c(spark, sf):
    return _resolved_labels(spark, sf)[1]


@register("o80_union_distinct", sql("SELECT chat_id, person_id FROM direct UNION SELECT chat_id, supplier_id FROM line WHERE flag = 'R'", "direct", "line"))
def o80(spark, sf):
    return _participants(spark, sf)


@register("o81_union_all", sql("SELECT chat_id, person_id FROM direct UNION ALL SELECT chat_id, supplier_id FROM line", "direct", "line"))
def o81(spark, sf):
    return view(spark, sf, "direct").union(view(spark, sf, "line").select("chat_id", "supplier_id"))


@register("o82_set_difference", sql("""SELECT guid, side, guid IN (SELECT 'g' || message_id FROM message WHERE kind = 'signup') AS accepted FROM (
  SELECT source_guid AS guid, 'only_a' AS side FROM message WHERE kind <> 'click' AND NOT value >= 20 UNION ALL SELECT source_guid, 'only_b' FROM message WHERE value >= 20 AND NOT kind <> 'click')""", "message"))
def o82(spark, sf):
    m = view(spark, sf, "message").withColumnRenamed("source_guid", "guid")
    return incremental.set_difference(m.where("kind <> 'click'"), m.where("value >= 20"), m.where("kind = 'signup'"))


@register("o85_similar_people")
def o85(spark, sf):
    near = identity.similar_people(view(spark, sf, "person"), F.lit("Custmer#000000012"))
    return near.orderBy(F.col("score").desc(), "short_name").limit(identity.MOST_CANDIDATES).select("person_id", "short_name", F.round("score", 6).alias("score"))


@register("o85_people_like_every_fiftieth")
def o85b(spark, sf):
    p = view(spark, sf, "person")
    return identity.most_similar_people(p, p.where("person_id % 50 = 0").select(F.col("person_id").alias("query_id"), F.replace("display_name", F.lit("to")).alias("query"))).withColumn("score", F.round("score", 6))


@register("o92_frontier", sql("""SELECT c.chat_id, CASE WHEN min(started_at) IS NULL THEN c.changed_at WHEN max(CASE WHEN sealed THEN started_at END) IS NULL THEN least(min(started_at), c.changed_at)
  ELSE coalesce(arg_max_null(nxt, CASE WHEN sealed THEN started_at END), c.changed_at) END AS recompute_from FROM (SELECT chat_id, changed_at, started_at, nxt, ended_at + INTERVAL 3 HOUR < changed_at AS sealed FROM chg LEFT JOIN (SELECT *, lead(started_at) OVER (PARTITION BY chat_id ORDER BY started_at) AS nxt FROM ss) USING (chat_id)) c GROUP BY c.chat_id, c.changed_at""", "message",
  ctes=SESSIONS + ", chg AS (SELECT chat_id, arg_min(sent_at, (message_id)) AS changed_at FROM message WHERE sent_at > TIMESTAMP '2024-01-28' GROUP BY 1)").replace("arg_max_null(nxt, CASE WHEN sealed THEN started_at END)", "(list(nxt ORDER BY CASE WHEN sealed THEN started_at END DESC NULLS LAST))[1]"))
def o92(spark, sf):
    changes = view(spark, sf, "message").where("sent_at > TIMESTAMP_NTZ '2024-01-28'").groupBy("chat_id").agg(F.min_by("sent_at", "message_id").alias("changed_at"))
    return sessions.recompute_start(_summaries(spark, sf), changes, 3.0)


@register("o133_watermark", sql("SELECT kind AS source, greatest(max(message_id), 3 * count(*)) AS rowid FROM message GROUP BY 1 UNION ALL SELECT status, count(*) FROM chat GROUP BY 1", "message", "chat"))
def o133(spark, sf):
    m = view(spark, sf, "message").withColumnRenamed("kind", "source")
    state = m.groupBy("source").agg((3 * F.count("*")).alias("rowid")).unionByName(view(spark, sf, "chat").groupBy(F.col("status").alias("source")).agg(F.count("*").alias("rowid")))
    return incremental.advance_watermarks(state, m.withColumnRenamed("message_id", "rowid"))


CONFIG = {"session_gap_hours": "3.0", "topical_min_messages": "6", "max_messages": "50"}
CONFIG_SQL = "sha256('seg_config_hash/v1 session_gap_hours=3.0 topical_min_messages=' || {} || ' max_messages=50')"


@register("o136_config_stale", sql(f"SELECT DISTINCT chat FROM segment WHERE CASE WHEN lang = 'fr' THEN NULL ELSE {CONFIG_SQL.format("CASE WHEN lang = 'de' THEN '7' ELSE '6' END")} END IS DISTINCT FROM {CONFIG_SQL.format("'6'")}", "segment"))
def o136(spark, sf):
    made = ids.config_hash(CONFIG | {"topical_min_messages": F.when(F.col("lang") == "de", "7").otherwise("6")})
    current = spark.range(1).select(ids.config_hash(CONFIG)).first()[0]
    return incremental.config_stale(view(spark, sf, "segment").withColumn("seg_config_hash", F.when(F.col("lang") != "fr", made)), current, group="chat")


@register("o119_config_hashes", "SELECT n_nationkey, sha256('seg_config_hash/v1 session_gap_hours=3.0 topical_min_messages=6 max_messages=' || n_nationkey) AS h FROM nation")
def o119(spark, sf):
    from colloquy.session import read_table

    return read_table(spark, sf, "nation").select("n_nationkey", ids.config_hash(CONFIG | {"max_messages": F.col("n_nationkey")}).alias("h"))


@register("o138_outbox", sql("""SELECT e.chat_id AS entity_id, e.event_id, CASE WHEN e.operation = 'delete' THEN 'deleted' WHEN p.person_id IS NULL THEN 'skipped' ELSE 'applied' END AS outcome FROM
  (SELECT chat_id, max(message_id) AS event_id, arg_max(CASE WHEN is_unsent THEN 'delete' ELSE 'upsert' END, message_id) AS operation FROM message WHERE message_id > 100 GROUP BY 1) e LEFT JOIN (SELECT person_id FROM person WHERE segment <> 'BUILDING') p ON p.person_id = e.chat_id""", "message", "person"))
def o138(spark, sf):
    events = view(spark, sf, "message").select(F.col("message_id").alias("event_id"), F.col("chat_id").alias("entity_id"), F.when(F.col("is_unsent"), "delete").otherwise("upsert").alias("operation"))
    content = view(spark, sf, "person").where("segment <> 'BUILDING'").select(F.col("person_id").alias("entity_id"), F.col("display_name").alias("text"))
    return incremental.apply_outbox(content.limit(0), events, content, 100)[1]


@register("o138_index_after_outbox", sql("""SELECT entity_id, text FROM (SELECT person_id AS entity_id, 'old' AS text FROM person) WHERE entity_id NOT IN (SELECT chat_id FROM message WHERE message_id > 100)
  UNION ALL SELECT p.person_id, p.display_name FROM (SELECT chat_id, arg_max(is_unsent, message_id) AS gone FROM message WHERE message_id > 100 GROUP BY 1) e JOIN person p ON p.person_id = e.chat_id WHERE p.segment <> 'BUILDING' AND NOT gone""", "message", "person"))
def o138b(spark, sf):
    events = view(spark, sf, "message").select(F.col("message_id").alias("event_id"), F.col("chat_id").alias("entity_id"), F.when(F.col("is_unsent"), "delete").otherwise("upsert").alias("operation"))
    people = view(spark, sf, "person")
    content = people.where("segment <> 'BUILDING'").select(F.col("person_id").alias("entity_id"), F.col("display_name").alias("text"))
    return incremental.apply_outbox(people.select(F.col("person_id").alias("entity_id"), F.lit("old").alias("text")), events, content, 100)[0]


@register("o140_reaction_backfill", sql("SELECT r.message_id AS tapback_id, t.message_id AS target_message_id FROM message r LEFT JOIN message t ON t.source_guid = 'g' || (r.message_id * 2) WHERE r.kind = 'click'", "message"))
def o140(spark, sf):
    m = view(spark, sf, "message")
    r = m.where("kind = 'click'").select(F.col("message_id").alias("tapback_id"), F.concat(F.lit("g"), (F.col("message_id") * 2).cast("string")).alias("target_guid"), F.lit(None).cast("long").alias("target_message_id"))
    return incremental.backfill_reactions(r, m).select("tapback_id", "target_message_id")


@register("o141_upsert", sql("""SELECT coalesce(o.person_id, n.person_id) AS person_id, coalesce(n.display_name, o.display_name) AS display_name, coalesce(o.segment, n.segment) AS segment,
  CASE WHEN o.person_id IS NULL OR n.display_name IS DISTINCT FROM o.display_name AND n.person_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
  FROM (SELECT * FROM person WHERE segment <> 'BUILDING') o FULL JOIN (SELECT person_id, CASE WHEN segment = 'FURNITURE' THEN upper(display_name) ELSE display_name END AS display_name, 'x' AS segment FROM person WHERE segment <> 'MACHINERY') n USING (person_id)""", "person"))
def o141(spark, sf):
    p = view(spark, sf, "person")
    old = p.where("segment <> 'BUILDING'").select("person_id", "display_name", "segment", F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    new = p.where("segment <> 'MACHINERY'").select("person_id", F.expr("CASE WHEN segment = 'FURNITURE' THEN upper(display_name) ELSE display_name END AS display_name"), F.lit("x").alias("segment"))
    return incremental.upsert(old, new, ["person_id"], ["display_name"], now=F.lit("2024-02-01").cast("timestamp_ntz"))


@register("o141_bucketed_upsert", sql("""SELECT coalesce(o.person_id, n.person_id) AS person_id, coalesce(n.display_name, o.display_name) AS display_name, coalesce(o.segment, n.segment) AS segment,
  CASE WHEN o.person_id IS NULL OR n.display_name IS DISTINCT FROM o.display_name AND n.person_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
  FROM (SELECT * FROM person WHERE segment <> 'BUILDING') o FULL JOIN (SELECT person_id, CASE WHEN segment = 'FURNITURE' THEN upper(display_name) ELSE display_name END AS display_name, 'x' AS segment FROM person WHERE segment <> 'MACHINERY') n USING (person_id)""", "person"))
def o141b(spark, sf):
    p = view(spark, sf, "person")
    old = p.where("segment <> 'BUILDING'").select("person_id", "display_name", "segment", F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    new = p.where("segment <> 'MACHINERY'").select("person_id", F.expr("CASE WHEN segment = 'FURNITURE' THEN upper(display_name) ELSE display_name END AS display_name"), F.lit("x").alias("segment"))
    table = incremental.create_buckets(old, shared_path(spark, "people"), ["person_id"], 16)
    incremental.upsert_buckets(table, new, ["display_name"], now=F.lit("2024-02-01").cast("timestamp_ntz"))
    return table.rows


@register("o144_rate_limit", sql("SELECT message_id AS event_id, ok AS allowed FROM folded", "message", ctes="""e AS (SELECT message_id, chat_id, epoch_us(sent_at) AS t, row_number() OVER (PARTITION BY chat_id ORDER BY sent_at, message_id) AS rn FROM message),
folded AS (SELECT message_id, chat_id, rn, true AS ok, t AS last, CAST(NULL AS BIGINT) AS before FROM e WHERE rn = 1
  UNION ALL SELECT e.message_id, e.chat_id, e.rn, coalesce(f.before <= e.t - 21600000000, true), CASE WHEN coalesce(f.before <= e.t - 21600000000, true) THEN e.t ELSE f.last END, CASE WHEN coalesce(f.before <= e.t - 21600000000, true) THEN f.last ELSE f.before END
  FROM folded f JOIN e ON e.chat_id = f.chat_id AND e.rn = f.rn + 1)"""))
def o144(spark, sf):
    events = view(spark, sf, "message").select(F.col("chat_id").alias("user_id"), F.col("sent_at").alias("ts"), F.col("message_id").alias("event_id"))
    return queue.rate_limited(events, 2, 6 * 3600.0).select("event_id", "allowed")


@register("o149_resolve_handles", sql("""SELECT source_handle_id, 'email' AS kind, lower(raw) AS normalized_value, CASE WHEN n = 1 THEN c END AS contact FROM (SELECT person_id AS source_handle_id, short_name || '@Example.com' AS raw FROM person) h
  LEFT JOIN (SELECT value, count(DISTINCT display_name) AS n, min(display_name) AS c FROM (SELECT replace(short_name, '1', '2') || '@example.com' AS value, display_name FROM person) GROUP BY 1) k ON k.value = lower(raw)""", "person"))
def o149(spark, sf):
    p = view(spark, sf, "person")
    handles = p.select(F.col("person_id").alias("source_handle_id"), F.concat("short_name", F.lit("@Example.com")).alias("raw_value"))
    contacts = p.select(F.concat(F.translate("short_name", "1", "2"), F.lit("@example.com")).alias("normalized_value"), F.col("display_name").alias("contact"))
    return identity.resolve_handles(handles, contacts)


IDENTITIES = """h AS (SELECT person_id AS source_handle_id, short_name || '@example.com' AS value FROM person),
c AS (SELECT DISTINCT contact, value FROM (SELECT 'C' || (person_id // 3) AS contact, short_name || '@example.com' AS value FROM person UNION ALL SELECT 'D' || segment, short_name || '@example.com' FROM person WHERE person_id % 11 = 0)),
k AS (SELECT value, min(person_id) AS known FROM (SELECT short_name || '@example.com' AS value, person_id // 10 AS person_id FROM person WHERE segment = 'FURNITURE') GROUP BY 1),
l AS (SELECT DISTINCT contact, known FROM c JOIN k USING (value)),
walk(contact, known) AS (SELECT contact, known FROM l UNION SELECT w.contact, l2.known FROM walk w JOIN l l1 ON l1.known = w.known JOIN l l2 ON l2.contact = l1.contact),
groups AS (SELECT contact, min(known) AS person FROM walk GROUP BY 1),
u AS (SELECT value, count(DISTINCT contact) AS n, min(contact) AS contact FROM c GROUP BY 1)"""


@register("o149_people", sql("""SELECT source_handle_id, h.value AS normalized_value, coalesce(k.known, g.person) AS person_id, CASE WHEN coalesce(k.known, g.person) IS NULL THEN coalesce('contact:' || u.contact, 'handle:email:' || h.value) END AS new_person
  FROM h LEFT JOIN (SELECT value, contact FROM u WHERE n = 1) u ON u.value = h.value LEFT JOIN groups g ON g.contact = u.contact LEFT JOIN k ON k.value = h.value""", "person", ctes=IDENTITIES))
def o149b(spark, sf):
    p = view(spark, sf, "person").withColumn("value", F.concat("short_name", F.lit("@example.com")))
    contacts = p.select(F.concat(F.lit("C"), F.expr("person_id div 3").cast("string")).alias("contact"), "value").union(p.where("person_id % 11 = 0").select(F.concat(F.lit("D"), "segment"), "value"))
    known = p.where("segment = 'FURNITURE'").select(F.col("value").alias("normalized_value"), F.expr("person_id div 10").alias("person_id"))
    handles = p.select(F.col("person_id").alias("source_handle_id"), F.concat(F.lit(" "), F.upper("value")).alias("raw_value"))
    return identity.resolve_people(handles, contacts.withColumnRenamed("value", "normalized_value"), known).select("source_handle_id", "normalized_value", "person_id", "new_person")


@register("o150_merge_people", sql("SELECT DISTINCT chat_id, CASE WHEN p.segment = 'FURNITURE' AND d.person_id % 10 <> 0 THEN d.person_id // 10 * 10 ELSE d.person_id END AS person_id FROM direct d JOIN person p USING (person_id)", "direct", "person"))
def o150(spark, sf):
    into = F.expr("person_id div 10 * 10")
    merges = view(spark, sf, "person").where("segment = 'FURNITURE'").select(F.col("person_id").alias("from_id"), into.alias("into_id")).where("from_id <> into_id")
    known = view(spark, sf, "direct").join(view(spark, sf, "person").select("person_id"), "person_id", "left_semi").select("chat_id", "person_id")
    return identity.merge_people(known, merges, unique_with="chat_id")


@register("o152_unclassified", sql("""SELECT r.chat_id, r.last_at FROM (SELECT chat_id, max(sent_at) AS last_at FROM line WHERE sent_at >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY GROUP BY 1) r
  JOIN (SELECT chat_id FROM direct LEFT JOIN allowlist USING (person_id) WHERE NOT coalesce(text_allowed, false) UNION SELECT chat_id FROM line WHERE flag = 'N') u USING (chat_id) LEFT JOIN chat c ON c.chat_id = r.chat_id AND c.status = 'F' WHERE c.chat_id IS NULL""", "line", "direct", "allowlist", "chat"))
def o152(spark, sf):
    line = view(spark, sf, "line")
    recent = line.where("sent_at >= TIMESTAMP_NTZ '2001-08-01' - INTERVAL 90 DAYS").groupBy("chat_id").agg(F.max("sent_at").alias("last_at"))
    unlisted = access.not_allowed(view(spark, sf, "direct"), view(spark, sf, "allowlist")).select("chat_id").union(line.where("flag = 'N'").select("chat_id")).distinct()
    return recent.join(unlisted, "chat_id", "left_semi").join(view(spark, sf, "chat").where("status = 'F'"), "chat_id", "left_anti").orderBy(F.col("last_at").desc(), "chat_id")


@register("o120_stable_keys", sql("SELECT chat_id, session_no, sha256('c' || chat_id || 'g' || first_message || 'g' || last_message || 'cfg') AS stable_key, 'd' || substr(sha256('segment:' || sha256('c' || chat_id || 'g' || first_message || 'g' || last_message || 'cfg')), 1, 62) AS document_id FROM ss", "message", ctes=SESSIONS))
def o120(spark, sf):
    guid = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = _summaries(spark, sf).withColumn("stable_key", ids.stable_key(guid("c", "chat_id"), guid("g", "first_message"), guid("g", "last_message"), "cfg"))
    return out.select("chat_id", "session_no", "stable_key", ids.segment_document_id(F.col("stable_key")).alias("document_id"))


@register("o118_opaque_keys", sql("SELECT message_id, sha256('message:' || source_guid) AS message_key, sha256('thread:c' || chat_id) AS thread_key FROM message", "message"))
def o118(spark, sf):
    return view(spark, sf, "message").select("message_id", ids.derived_key("message", F.col("source_guid")).alias("message_key"), ids.derived_key("thread", F.concat(F.lit("c"), F.col("chat_id").cast("string"))).alias("thread_key"))


@register("o127_apple_epoch", sql("SELECT message_id, (epoch_us(sent_at) - 978307200000000) * 1000 AS ns, CASE WHEN kind = 'click' THEN NULL ELSE sent_at END AS back FROM message", "message"))
def o127(spark, sf):
    m = view(spark, sf, "message").withColumn("ns", times.to_apple_ns(F.col("sent_at").cast("timestamp")))
    return m.select("message_id", "ns", times.from_apple_ns(F.when(F.col("kind") != "click", F.col("ns")).otherwise(0)).cast("timestamp_ntz").alias("back"))


@register("o128_lenient_iso", sql("SELECT message_id, CASE WHEN kind = 'click' THEN NULL ELSE date_trunc('second', sent_at) END AS at FROM message", "message"))
def o128(spark, sf):
    raw = F.when(F.col("kind") == "click", "yesterday").otherwise(F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return view(spark, sf, "message").select("message_id", times.lenient_iso(raw).cast("timestamp_ntz").alias("at"))


@register("o129_freshness", sql("SELECT kind AS source, max(sent_at) AS last_ok, CAST((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(sent_at))) // 1000000 AS BIGINT) AS age_seconds, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(sent_at)) < 2 * 900 * 1000000 AS fresh FROM message GROUP BY 1", "message"))
def o129(spark, sf):
    runs = view(spark, sf, "message").select(F.col("kind").alias("source"), F.col("message_id").alias("run_id"), F.col("sent_at").alias("finished_at"), F.lit(True).alias("ok"))
    return incremental.freshness(incremental.last_ok_runs(runs).drop("run_id"), F.lit("2024-01-31").cast("timestamp"), 900)


@register("o130_recent", sql("SELECT chat_id, count(*) AS n, max(sent_at) AS last_at FROM line WHERE sent_at >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY GROUP BY 1", "line"))
def o130(spark, sf):
    return incremental.active_chats(view(spark, sf, "line"), F.lit("2001-08-01").cast("timestamp"))


@register("o131_slots", "SELECT n_nationkey, CAST(m AS BIGINT) AS minute_of_day FROM (SELECT n_nationkey, unnest(range((n_nationkey % 5) * 60, (n_nationkey % 5) * 60 + 121, 30)) AS m FROM nation)")
def o131(spark, sf):
    from colloquy.session import read_table

    hour = F.col("n_nationkey") % 5
    window = F.format_string("%02d:00-%02d:00", hour, hour + 2)
    return read_table(spark, sf, "nation").select("n_nationkey", F.explode(times.slots(window)).alias("m")).select("n_nationkey", F.col("m").cast("long").alias("minute_of_day"))


def flagship(spark, sf):
    """Sessions of all chats, however large a chat is, and of each the messages, time span and attachments."""
    s = _sessions(spark, sf)
    return s.groupBy("chat_id", "session_no").agg(F.count("*").alias("messages"), F.min("sent_at").alias("started_at"), F.max("sent_at").alias("ended_at"), F.count_if("has_attachments").alias("attachments"), F.count_if("is_unsent").alias("unsent"))


@register("o99_segment_summary", sql("SELECT s.chat_id, CAST(s.session_no AS BIGINT) AS session_no, bool_or(has_attachments) AS has_attachments, coalesce(string_agg(DISTINCT short_name, ',' ORDER BY short_name), '') AS people FROM s LEFT JOIN person p ON p.person_id = s.sender_person_id GROUP BY 1, 2", "message", "person", ctes=SESSIONS))
def o99(spark, sf):
    s = _sessions(spark, sf).withColumn("segment_id", F.struct("chat_id", "session_no")).withColumnRenamed("sender_person_id", "person_id")
    out = segments.segment_summaries(s.select("segment_id").distinct(), s, view(spark, sf, "person"))
    return out.select("segment_id.chat_id", "segment_id.session_no", "has_attachments", F.array_join("people", ",").alias("people"))


STABLE = "sha256('c' || chat_id || 'g' || first_message || 'g' || last_message || 'cfg')"
ANCHORS = SESSIONS + f""", seg AS (SELECT chat_id, {STABLE} AS stable_key, session_no, started_at FROM ss), latest AS (SELECT chat_id, max(started_at) AS latest_at FROM seg GROUP BY 1)"""


@register("o100_thread_resolution", sql("""SELECT 'a' || chat_id || '-' || session_no AS request_id, chat_id, sha256('thread:c' || chat_id) AS thread_key, started_at AS anchor_at, CAST(NULL AS VARCHAR) AS error FROM seg
  UNION ALL SELECT 'b' || chat_id, chat_id, sha256('thread:c' || chat_id), latest_at, NULL FROM latest
  UNION ALL SELECT 'm' || message_id, CASE WHEN kind <> 'error' THEN chat_id END, CASE WHEN kind <> 'error' THEN sha256('thread:c' || chat_id) END, CASE kind WHEN 'click' THEN sent_at WHEN 'view' THEN date_trunc('second', sent_at) END, CASE kind WHEN 'error' THEN 'not_found' WHEN 'click' THEN NULL WHEN 'view' THEN NULL ELSE 'bad_anchor' END FROM message""", "message", ctes=ANCHORS))
def o100(spark, sf):
    m = view(spark, sf, "message")
    guid = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    told = _summaries(spark, sf).withColumn("stable_key", ids.stable_key(guid("c", "chat_id"), guid("g", "first_message"), guid("g", "last_message"), "cfg"))
    chats = m.select("chat_id").distinct().withColumn("thread_key", ids.derived_key("thread", guid("c", "chat_id")))
    keyed = m.withColumn("message_key", ids.derived_key("message", F.col("source_guid"))).join(chats, "chat_id")
    anchor = F.when(F.col("kind") == "view", F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("kind") == "click", F.col("message_key")).otherwise(F.lit("no such key"))
    asked = told.select(F.concat_ws("-", guid("a", "chat_id"), F.col("session_no").cast("string")).alias("request_id"), F.col("stable_key").alias("thread_id"), F.lit(None).cast("string").alias("anchor"))
    asked = asked.unionByName(chats.select(guid("b", "chat_id").alias("request_id"), F.col("thread_key").alias("thread_id"), F.lit(None).cast("string").alias("anchor")))
    asked = asked.unionByName(keyed.select(guid("m", "message_id").alias("request_id"), F.when(F.col("kind") == "error", guid("none", "message_id")).otherwise(F.col("thread_key")).alias("thread_id"), anchor.alias("anchor")))
    return segments.resolve_anchors(asked, told, chats, keyed)


@register("o110_render_segments", sql("""SELECT chat_id || '-' || session_no AS segment_id, sha256('Chat: p' || chat_id || chr(10) || 'Time: ' || strftime(min(sent_at), '%Y-%m-%d %H:%M') || ' – ' || CASE WHEN CAST(min(sent_at) AS DATE) = CAST(max(sent_at) AS DATE) THEN strftime(max(sent_at), '%H:%M') ELSE strftime(max(sent_at), '%Y-%m-%d %H:%M') END || ' UTC' || chr(10) || '---' || chr(10) || string_agg(line, chr(10) ORDER BY sent_at, message_id)) AS rendered_sha256 FROM (
  SELECT chat_id, CAST(session_no AS BIGINT) AS session_no, sent_at, message_id, '[' || strftime(sent_at, '%H:%M') || '] ' || CASE WHEN is_from_me THEN 'owner' ELSE 'p' || sender_person_id END || ': ' || text || CASE WHEN kind = 'click' THEN ' ♥' ELSE '' END AS line FROM s) GROUP BY chat_id, session_no""", "message", ctes=SESSIONS))
def o110(spark, sf):
    none = F.array().cast("array<string>")
    s = _sessions(spark, sf).withColumn("segment_id", F.concat_ws("-", F.col("chat_id").cast("string"), F.col("session_no").cast("string")))
    sender = F.when(F.col("is_from_me"), "owner").otherwise(F.concat(F.lit("p"), F.col("sender_person_id").cast("string")))
    reactions = F.when(F.col("kind") == "click", F.array(text.reaction_symbol(F.lit("loved")))).otherwise(none)
    lines = s.withColumn("line", rendering.message_line(F.col("sent_at"), sender, F.col("text"), none, None, reactions))
    spans = s.groupBy("segment_id").agg(F.first("chat_id").alias("chat_id"), F.min("sent_at").alias("started_at"), F.max("sent_at").alias("ended_at"))
    people = F.array(F.concat(F.lit("p"), F.col("chat_id").cast("string")))
    heads = spans.select("segment_id", rendering.header(people, F.lit("dm"), F.lit(None).cast("string"), F.col("started_at"), F.col("ended_at")).alias("head"))
    return rendering.render_segments(lines, heads).select("segment_id", "rendered_sha256")


@register("o135_changed_since_segmented", sql("SELECT m.chat_id, count(*) AS changed FROM message m LEFT JOIN (SELECT chat_id, max(ended_at) - INTERVAL 2 DAY AS done_at FROM ss WHERE chat_id IN (SELECT chat_id FROM message WHERE kind = 'view') GROUP BY 1) d USING (chat_id) WHERE d.done_at IS NULL OR m.sent_at > d.done_at GROUP BY 1", "message", ctes=SESSIONS))
def o135(spark, sf):
    m = view(spark, sf, "message")
    done = _summaries(spark, sf).join(m.where("kind = 'view'"), "chat_id", "left_semi").groupBy("chat_id").agg((F.max("ended_at") - F.expr("INTERVAL 2 DAYS")).alias("done_at"))
    return incremental.changed_since(m, done).groupBy("chat_id").agg(F.count("*").alias("changed"))


@register("o114_normalize_handles", sql("SELECT person_id, CASE WHEN person_id % 3 = 0 THEN 'email' WHEN person_id % 3 = 1 THEN 'phone' ELSE 'unknown' END AS kind, CASE WHEN person_id % 3 = 0 THEN short_name || '@x.org' WHEN person_id % 3 = 1 THEN '+1' || CAST(2025550000 + person_id AS VARCHAR) ELSE display_name END AS value FROM person", "person"))
def o114(spark, sf):
    raw = F.expr("CASE WHEN person_id % 3 = 0 THEN concat(' ', upper(short_name), '@X.org') WHEN person_id % 3 = 1 THEN concat('(202) ', substr(cast(2025550000 + person_id as string), 4, 3), '-', substr(cast(2025550000 + person_id as string), 7, 4)) ELSE display_name END")
    kind, value = text.normalize_handle(raw)
    return view(spark, sf, "person").select("person_id", kind.alias("kind"), value.alias("value"))


@register("o113_short_names", sql("SELECT person_id, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS short_name FROM (SELECT person_id, lower(segment) AS s, row_number() OVER (PARTITION BY segment ORDER BY person_id) AS n FROM person)", "person"))
def o113(spark, sf):
    return identity.short_names(view(spark, sf, "person").drop("short_name"), "segment").select("person_id", "short_name")


REVOKED = """flags AS (SELECT w.person_id, CASE WHEN p.segment = 'FURNITURE' THEN false ELSE w.text_allowed END AS ok, p.segment = 'FURNITURE' AS gone FROM allowlist w JOIN person p USING (person_id)),
allowed AS (SELECT chat_id FROM direct JOIN flags USING (person_id) WHERE ok)"""


@register("o147_purge_plan", sql("SELECT chat_id AS document_id, CASE WHEN chat_id IN (SELECT chat_id FROM allowed) THEN 'unchanged' ELSE 'delete' END AS action FROM chat WHERE status <> 'P'", "direct", "allowlist", "person", "chat", ctes=REVOKED))
def o147(spark, sf):
    return _purge(spark, sf)[1]


@register("o147_allowlist_after_purge", sql("SELECT person_id, ok AS text_allowed, CASE WHEN gone THEN false ELSE attachments_allowed END AS attachments_allowed FROM flags JOIN allowlist USING (person_id)", "direct", "allowlist", "person", ctes=REVOKED))
def o147b(spark, sf):
    return _purge(spark, sf)[0]


def _purge(spark, sf):
    chats = view(spark, sf, "chat")
    pushed = chats.where("status <> 'P'").select(F.col("chat_id").alias("document_id"), "chat_id", F.sha2("status", 256).alias("content_sha256"))
    revoked = view(spark, sf, "person").where("segment = 'FURNITURE'")
    return upkeep.purge_plan(view(spark, sf, "allowlist"), revoked, chats, view(spark, sf, "direct"), pushed, pushed)