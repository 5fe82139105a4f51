"""Queries over texts, vectors, ranked lists, evaluation, attachments and exports."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import ids, text, times, vectors
from colloquy.operators import access, attachments, evaluation, incremental, lexical, nearest, queue, ranking, rendering, segments
from colloquy.plans import upkeep
from colloquy.plans.search import SearchTables, hybrid_search
from colloquy.plans.views import rebuild_index, register, segment_index, sql, view
from colloquy.session import shared_path
from colloquy.sources import extract

# attachments and enrichment

MIME_KIND = "CASE WHEN mime_type = 'application/pdf' THEN 'pdf' WHEN starts_with(mime_type, 'image/') THEN 'image' WHEN starts_with(mime_type, 'audio/') THEN 'audio' WHEN starts_with(mime_type, 'video/') THEN 'video' ELSE 'other' END"
ROUTED = f"routed AS (SELECT attachment_id, tries, price, state, unnest(CASE {MIME_KIND} WHEN 'pdf' THEN ['pdf_text'] WHEN 'image' THEN ['ocr', 'caption'] WHEN 'audio' THEN ['transcript'] WHEN 'video' THEN ['frame_ocr', 'caption', 'transcript'] END) AS kind FROM attachment)"
NOW = "2024-01-01 12:00:00"
QUEUE = ROUTED + f""",
tasks AS (SELECT attachment_id, kind, CASE attachment_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS state, CAST(tries % 4 AS INTEGER) AS attempts,
  TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * tries * 20 AS next_attempt_at, CASE WHEN attachment_id % 4 = 1 THEN TIMESTAMP '{NOW}' - INTERVAL 1 MINUTE * tries END AS locked_at FROM routed)"""


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "attachment").withColumn("kind", F.explode(queue.routes(text.mime_kind(F.col("mime_type")))))


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("pending", "running", "done", "failed"))), (F.col("attachment_id") % 4 + 1).cast("int"))
    minute = F.make_dt_interval(mins=F.col("tries"))
    return _routed(spark, sf).select(
        "attachment_id", "kind", state.alias("state"), (F.col("tries") % 4).alias("attempts"), (F.lit("2024-01-01").cast("timestamp_ntz") + minute * 20).alias("next_attempt_at"),
        F.when(F.col("attachment_id") % 4 == 1, F.lit(NOW).cast("timestamp_ntz") - minute).alias("locked_at"), F.lit(None).cast("string").alias("locked_by"),
    )


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@register("o29_mime_kind", sql(f"SELECT attachment_id, {MIME_KIND} AS kind FROM attachment", "attachment"))
def o29(spark, sf):
    return view(spark, sf, "attachment").select("attachment_id", text.mime_kind(F.col("mime_type")).alias("kind"))


@register("o30_mime_routes", sql("SELECT attachment_id, kind FROM routed", "attachment", ctes=ROUTED))
def o30(spark, sf):
    return _routed(spark, sf).select("attachment_id", "kind")


@register("o28_enrichment_pivot", sql("""SELECT attachment_id, max(CASE WHEN kind = 'pdf_text' THEN t END) AS pdf_text, max(CASE WHEN kind = 'caption' THEN t END) AS caption, coalesce(max(CASE WHEN kind = 'frame_ocr' THEN t END), max(CASE WHEN kind = 'ocr' THEN t END)) AS ocr_text, max(CASE WHEN kind = 'transcript' THEN t END) AS transcript
  FROM (SELECT *, kind || ' of ' || attachment_id AS t FROM tasks WHERE state = 'done') GROUP BY 1""", "attachment", ctes=QUEUE))
def o28(spark, sf):
    return attachments.pivot_enrichments(_tasks(spark, sf).withColumn("text", F.concat("kind", F.lit(" of "), F.col("attachment_id").cast("string"))))


@register("o30_initial_enqueue", sql("SELECT attachment_id, kind FROM routed WHERE (attachment_id, kind) NOT IN (SELECT attachment_id, kind FROM tasks WHERE state = 'done')", "attachment", ctes=QUEUE))
def o30b(spark, sf):
    return queue.enqueue(_tasks(spark, sf).where("state = 'done'"), _routed(spark, sf))


CLAIMABLE = f"next_attempt_at <= TIMESTAMP '{NOW}' AND (state = 'pending' OR (state = 'running' AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 900 SECOND))"


@register("o50_queue_preview", sql(f"SELECT kind, count(*) AS n FROM tasks WHERE {CLAIMABLE} GROUP BY 1", "attachment", ctes=QUEUE))
def o50(spark, sf):
    return _tasks(spark, sf).where(queue.is_claimable(_now())).groupBy("kind").agg(F.count("*").alias("n"))


@register("o73_claim", sql(f"SELECT attachment_id, kind, attempts FROM tasks WHERE {CLAIMABLE} ORDER BY next_attempt_at, attachment_id, kind LIMIT 25", "attachment", ctes=QUEUE))
def o73(spark, sf):
    return queue.claim(_tasks(spark, sf), _now(), 25, "worker-1").select("attachment_id", "kind", "attempts")


@register("o142_settle", sql(f"""SELECT attachment_id, kind, CASE WHEN outcome IN ('done', 'skipped') THEN outcome WHEN outcome = 'permanent' OR (outcome = 'error' AND attempts + 1 >= 3) THEN 'failed' WHEN outcome = 'error' THEN 'pending' ELSE state END AS state,
  CAST(CASE WHEN outcome = 'error' THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts, CASE WHEN outcome = 'error' AND attempts + 1 < 3 THEN TIMESTAMP '{NOW}' + INTERVAL 1 SECOND * CAST(60 * pow(2, attempts) AS BIGINT) ELSE next_attempt_at END AS next_attempt_at
  FROM (SELECT *, CASE WHEN state = 'running' THEN CASE attachment_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'skipped' ELSE 'permanent' END END AS outcome FROM tasks)""", "attachment", ctes=QUEUE))
def o142(spark, sf):
    tasks = _tasks(spark, sf)
    outcome = F.element_at(F.array(*map(F.lit, ("done", "error", "error", "skipped", "permanent"))), (F.col("attachment_id") % 5 + 1).cast("int"))
    return queue.settle(tasks, tasks.where("state = 'running'").select("attachment_id", "kind", outcome.alias("outcome")), _now(), 3).select("attachment_id", "kind", "state", "attempts", "next_attempt_at")


@register("o132_backoff", sql("SELECT attachment_id, kind, CAST(60 * pow(2, attempts) AS BIGINT) AS seconds FROM tasks", "attachment", ctes=QUEUE))
def o132(spark, sf):
    return _tasks(spark, sf).select("attachment_id", "kind", times.backoff_seconds(F.col("attempts") + 1).cast("long").alias("seconds"))


@register("o143_materialize", sql("SELECT attachment_id, CAST(tries % 4 + CASE WHEN on_disk THEN 0 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN on_disk THEN 'materialized' WHEN state = 'error' THEN 'error' WHEN tries % 4 + 1 >= 3 THEN 'missing' ELSE 'dataless' END AS state FROM attachment", "attachment"))
def o143(spark, sf):
    a = view(spark, sf, "attachment").withColumn("attempts", F.col("tries") % 4).withColumn("outcome", F.when(F.col("on_disk"), "present").when(F.col("state") == "error", "error").otherwise("absent"))
    return queue.materialize_step(a).select("attachment_id", F.col("attempts").cast("int").alias("attempts"), "state")


GAPS = """gaps AS (SELECT *, state = 'materialized' AND on_disk AS present, CASE WHEN state = 'materialized' THEN 'error' WHEN state = 'dataless' THEN 'dataless_retrying' WHEN state = 'missing' THEN 'remote_missing' ELSE 'error' END AS category FROM attachment)"""


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return attachments.reconcile_files(view(spark, sf, "attachment"))


@register("o153_reconcile_files", sql("SELECT attachment_id, present, CASE WHEN NOT present THEN category END AS category FROM gaps", "attachment", ctes=GAPS))
def o153(spark, sf):
    return _gaps(spark, sf).select("attachment_id", "present", "category")


@register("o58_completeness", sql("SELECT count(*) FILTER (present) AS present, count(*) AS total, count(*) FILTER (present) / count(*) AS ratio FROM gaps", "attachment", ctes=GAPS))
def o58(spark, sf):
    return attachments.completeness(_gaps(spark, sf))


@register("o49_by_year_and_mime", sql("SELECT coalesce(CAST(y AS VARCHAR), 'unknown') AS year, mime_type, count(*) FILTER (present) AS present, count(*) AS total, count(*) FILTER (present) / count(*) AS ratio FROM gaps LEFT JOIN (SELECT attachment_id, min(year(sent_at)) AS y FROM line GROUP BY 1) USING (attachment_id) GROUP BY 1, 2", "attachment", "line", ctes=GAPS))
def o49(spark, sf):
    years = view(spark, sf, "line").groupBy("attachment_id").agg(F.min(F.year("sent_at")).alias("y"))
    return attachments.completeness(_gaps(spark, sf).join(years, "attachment_id", "left"), [F.coalesce(F.col("y").cast("string"), F.lit("unknown")).alias("year"), F.col("mime_type")])


@register("o154_exceptions", sql("SELECT category, state, count(*) AS n FROM gaps WHERE NOT present GROUP BY 1, 2", "attachment", ctes=GAPS))
def o154(spark, sf):
    return _gaps(spark, sf).where("not present").groupBy("category", "state").agg(F.count("*").alias("n"))


@register("o154_integrity_sample", sql("SELECT attachment_id FROM gaps WHERE present ORDER BY sha256('7|' || attachment_id), attachment_id LIMIT 25", "attachment", ctes=GAPS))
def o154b(spark, sf):
    return attachments.sample_for_integrity(_gaps(spark, sf).where("present"), 25, 7).select("attachment_id")


@register("o161_dataless", sql("SELECT attachment_id, state = 'dataless' OR (NOT on_disk AND tries > 0) AS dataless FROM attachment", "attachment"))
def o161(spark, sf):
    flags = F.when(F.col("state") == "dataless", "uchg,dataless").otherwise("-")
    told = extract.dataless(F.col("tries"), F.when(F.col("on_disk"), 8).otherwise(0), flags)
    return view(spark, sf, "attachment").select("attachment_id", told.alias("dataless"))


@register("o145_paced_starts", sql("SELECT attachment_id, (row_number() OVER (ORDER BY attachment_id) - 1) * 0.5 AS starts_after FROM attachment WHERE state = 'dataless' ORDER BY attachment_id LIMIT 200", "attachment"))
def o145(spark, sf):
    first = ranking.ranked(view(spark, sf, "attachment").where("state = 'dataless'"), [F.col("attachment_id")], 200)
    return first.select("attachment_id", queue.paced(F.col("rank") - 1, 120).alias("starts_after"))


@register("o157_ceilings", sql("SELECT attachment_id, CASE WHEN tries > 40 THEN 'too_many_tries' WHEN price > 1500 THEN 'too_many_price' END AS refused FROM attachment", "attachment"))
def o157(spark, sf):
    return attachments.within_limits(view(spark, sf, "attachment"), {"tries": 40, "price": 1500}).select("attachment_id", "refused")


@register("o151_task_outcomes", sql("SELECT attachment_id, kind, CASE WHEN attachment_id % 9 = 0 OR (attachment_id % 9 = 1 AND attempts + 1 >= 3) THEN 'failed' WHEN attachment_id % 9 = 1 THEN 'retry' WHEN kind IN ('caption', 'ocr', 'frame_ocr') AND attachment_id % 9 = 2 THEN 'skipped' ELSE 'done' END AS outcome FROM tasks", "attachment", ctes=QUEUE))
def o151(spark, sf):
    n = F.col("attachment_id") % 9
    outcome = attachments.task_outcome(F.col("kind"), F.when(n == 2, " ").otherwise("text"), F.when(n == 0, "permanent").when(n == 1, "transient"), F.col("attempts"), 3)
    return _tasks(spark, sf).select("attachment_id", "kind", outcome.alias("outcome"))


@register("o126_frame_paths", sql("SELECT attachment_id, 'f/' || attachment_id || '/1.jpg' || chr(10) || 'f/' || attachment_id || '/2.jpg' AS paths, sha256('f/' || attachment_id || '/1.jpg' || chr(10) || 'f/' || attachment_id || '/2.jpg') AS paths_sha256 FROM attachment", "attachment"))
def o126(spark, sf):
    n = F.col("attachment_id").cast("string")
    detail = F.concat(F.lit('{"frames": [{"timestamp_seconds": 2.0, "path": "f/'), n, F.lit('/2.jpg"}, {"text": null, "path": "f/'), n, F.lit('/1.jpg"}, {"text": "x"}]}'))
    paths, digest = attachments.frame_paths(detail)
    return view(spark, sf, "attachment").select("attachment_id", F.array_join(paths, "\n").alias("paths"), digest.alias("paths_sha256"))


WORDS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"

# joins and staleness


@register("o34_chunk_chain", sql("SELECT DISTINCT c.status, a.mime_type, l.chat_id FROM attachment a JOIN line l USING (attachment_id) JOIN chat c USING (chat_id) JOIN recipient d USING (chat_id) JOIN allowlist w USING (person_id) WHERE a.state = 'missing' AND w.text_allowed", "attachment", "line", "chat", "recipient", "allowlist"))
def o34(spark, sf):
    a = view(spark, sf, "attachment").where("state = 'missing'")
    allowed = view(spark, sf, "recipient").select("chat_id", "person_id").join(view(spark, sf, "allowlist").where("text_allowed"), "person_id", "left_semi")
    chain = a.join(view(spark, sf, "line"), "attachment_id").join(view(spark, sf, "chat"), "chat_id").join(allowed, "chat_id")
    return chain.select("status", "mime_type", "chat_id").distinct()


@register("o35_stale", sql("SELECT segment_id, sha256(text) AS text_sha256 FROM segment LEFT JOIN (SELECT segment_id, CASE WHEN label < 3 THEN sha256(CAST(label AS VARCHAR)) ELSE (SELECT sha256(text) FROM segment s WHERE s.segment_id = vector.segment_id) END AS done FROM vector) v USING (segment_id) WHERE sha256(text) IS DISTINCT FROM v.done", "segment", "vector"))
def o35(spark, sf):
    s = view(spark, sf, "segment").select("segment_id", ids.sha256_text(F.col("text")).alias("text_sha256"))
    done = view(spark, sf, "vector").join(s, "segment_id", "left").select("segment_id", F.when(F.col("label") < 3, F.sha2(F.col("label").cast("string"), 256)).otherwise(F.col("text_sha256")).alias("done"))
    return incremental.stale(s, done, "segment_id", "text_sha256", "done")


@register("o41_reconcile", sql("SELECT coalesce(d.segment_id, c.segment_id) AS document_id, CASE WHEN d.segment_id IS NULL THEN 'delete' WHEN c.segment_id IS NULL OR c.h IS DISTINCT FROM d.h THEN 'upsert' ELSE 'unchanged' END AS action FROM (SELECT segment_id, sha256(text) AS h FROM segment WHERE lang <> 'fr') d FULL JOIN (SELECT segment_id, CASE WHEN lang = 'de' THEN 'old' ELSE sha256(text) END AS h FROM segment WHERE chat <> 'src3') c USING (segment_id)", "segment"))
def o41(spark, sf):
    s = view(spark, sf, "segment").select(F.col("segment_id").alias("document_id"), ids.sha256_text(F.col("text")).alias("content_sha256"), "lang", "chat")
    old = s.withColumn("content_sha256", F.when(F.col("lang") == "de", "old").otherwise(F.col("content_sha256")))
    return access.reconcile(s.where("lang <> 'fr'"), old.where("chat <> 'src3'"))


@register("o137_hash_skip", sql("SELECT segment_id FROM segment WHERE sha256(text) IS DISTINCT FROM (CASE WHEN lang = 'de' THEN NULL WHEN lang = 'fr' THEN sha256(text || '.') ELSE sha256(text) END)", "segment"))
def o137(spark, sf):
    s = view(spark, sf, "segment").select("segment_id", ids.sha256_text(F.col("text")).alias("text_sha256"), "lang", "text")
    stored = s.where("lang <> 'de'").select("segment_id", F.when(F.col("lang") == "fr", F.sha2(F.concat("text", F.lit(".")), 256)).otherwise(F.col("text_sha256")).alias("stored_sha256"))
    return incremental.stale(s, stored, "segment_id", "text_sha256", "stored_sha256").select("segment_id")


@register("o45_attachment_gate", sql("SELECT chat_id AS segment_id, attachment_id, bool_and(coalesce(quantity > 5, false)) AS content_eligible FROM line WHERE flag <> 'A' GROUP BY 1, 2", "line"))
def o45(spark, sf):
    return access.attachment_gate(view(spark, sf, "line").select(F.col("chat_id").alias("segment_id"), "attachment_id", (F.col("quantity") > 5).alias("allowed"), (F.col("flag") == "A").alias("is_unsent")))


@register("o83_new_people", sql("SELECT DISTINCT person_id FROM recipient WHERE priority = '1-URGENT' AND person_id NOT IN (SELECT person_id FROM recipient WHERE priority <> '1-URGENT')", "recipient"))
def o83(spark, sf):
    d = view(spark, sf, "recipient")
    return access.scope_reasons(d.where("priority = '1-URGENT'"), d.where("priority <> '1-URGENT'"), "person_id")


def _bm25_ctes(phrase: str, digits: int | None = 6) -> str:
    terms = lexical.query_phrases(phrase)
    assert all(len(t) == 1 for t in terms)
    names = [t[0] for t in terms]
    tf = ", ".join(f"CAST(len(list_filter(w, lambda t: t = '{n}')) AS BIGINT) AS tf{i}" for i, n in enumerate(names))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(names)))
    idf = lambda i: f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(names)))
    both = " AND ".join(f"tf{i} > 0" for i in range(len(names)))
    score = score if digits is None else f"round({score}, {digits})"
    return f"t AS (SELECT segment_id, {WORDS} AS w FROM segment), c AS (SELECT segment_id, len(w) AS dl, {tf} FROM t), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c), scored AS (SELECT segment_id, {score} AS score FROM c, st WHERE {both})"


def _bm25_sql(phrase: str, k: int) -> str:
    return sql(f"SELECT segment_id, score, row_number() OVER (ORDER BY score DESC, segment_id) AS rank FROM scored ORDER BY score DESC, segment_id LIMIT {k}", "segment", ctes=_bm25_ctes(phrase))


def _phrase_ctes(phrase: str, digits: int | None = 6) -> str:
    """Scores of a phrase that does not overlap itself, over trigrams."""
    idf = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END"
    score = f"({idf}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    score = score if digits is None else f"round({score}, {digits})"
    return f"""c AS (SELECT segment_id, greatest(length(lower(text)) - 2, 0) AS dl, (length(lower(text)) - length(replace(lower(text), '{phrase}', ''))) // {len(phrase)} AS tf FROM segment),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM c), scored AS (SELECT segment_id, {score} AS score FROM c, st WHERE tf > 0)"""


@register("o139_rebuild", sql(f"SELECT (SELECT count(*) FROM segment) AS n_docs, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_terms, (SELECT max(message_id) FROM message) AS position FROM (SELECT segment_id, term, count(*) AS tf FROM (SELECT segment_id, unnest({WORDS}) AS term FROM segment) GROUP BY ALL)", "segment", "message"))
def o139(spark, sf):
    events = view(spark, sf, "message").select(F.col("message_id").alias("event_id"))
    made = rebuild_index(spark, sf, upkeep.outbox_position(events))
    return spark.createDataFrame([(made.n_docs, made.n_postings, made.n_terms, made.position)], "n_docs long, n_postings long, n_terms long, position long")


def _updated_index(spark: SparkSession, sf: str, kind: str) -> lexical.LexicalIndex:
    """An index of old contents, brought up to date by two batches of events: German texts changed, those of one chat are new, those of another are gone."""
    now = view(spark, sf, "segment").select("segment_id", "chat", "lang", "text")
    old = now.where("chat <> 'src1'").withColumn("text", F.when(F.col("lang") == "de", "with that from, that was the old text").otherwise(F.col("text")))
    index = lexical.write_index(old, shared_path(spark, "updated"), kind=kind)
    first = now.where("chat = 'src1' OR lang = 'de'").select((2 * F.col("segment_id") + 1).alias("event_id"), "segment_id", F.lit("upsert").alias("operation"))
    second = now.where("chat IN ('src1', 'src2')").select((2 * F.col("segment_id") + 2 + 4_000_000_000).alias("event_id"), "segment_id", F.when(F.col("chat") == "src2", "delete").otherwise("upsert").alias("operation"))
    there = now.where("chat <> 'src2'")
    index = lexical.apply_events(index, first, now)
    return lexical.apply_events(index, first.unionByName(second), there)


def _present(ctes: str) -> str:
    return ctes.replace("FROM segment)", "FROM segment WHERE chat <> 'src2')")


@register("o138_search_after_events", sql("SELECT segment_id, score FROM scored", "segment", ctes=_present(_bm25_ctes("with that from"))))
def o138c(spark, sf):
    return _updated_index(spark, sf, "word").search("with that from").withColumn("score", F.round("score", 6))


@register("o138_phrase_after_events", sql("SELECT segment_id, score FROM scored", "segment", ctes=_present(_phrase_ctes("tion of th"))))
def o138d(spark, sf):
    return _updated_index(spark, sf, "trigram").search("tion of th").withColumn("score", F.round("score", 6))


@register("o139_compacted", sql("SELECT segment_id, score FROM scored", "segment", ctes=_present(_bm25_ctes("that the"))))
def o139b(spark, sf):
    return lexical.compact(_updated_index(spark, sf, "word")).search("that the").withColumn("score", F.round("score", 6))


@register("o146_drift", sql("SELECT segment_id FROM segment WHERE lang = 'es' OR chat = 'src5'", "segment"))
def o146(spark, sf):
    s = view(spark, sf, "segment").select("segment_id", "lang", "chat", F.sha2("text", 256).alias("content_sha256"))
    now = s.where("chat <> 'src5'").withColumn("content_sha256", F.when(F.col("lang") == "es", "changed").otherwise(F.col("content_sha256")))
    return upkeep.drifted(s, now, key="segment_id")


@register("o159_migrations", sql("SELECT coalesce(a.segment_id, d.segment_id) AS version, CASE WHEN a.segment_id IS NULL THEN 'pending' WHEN d.segment_id IS NULL THEN 'missing' WHEN d.lang = 'de' THEN 'hash_mismatch' ELSE 'applied' END AS state FROM (SELECT segment_id FROM segment WHERE chat <> 'src1') a FULL JOIN (SELECT segment_id, lang FROM segment WHERE chat <> 'src2') d USING (segment_id)", "segment"))
def o159(spark, sf):
    s = view(spark, sf, "segment").select(F.col("segment_id").alias("version"), F.sha2("text", 256).alias("sha256"), "lang", "chat")
    on_disk = s.where("chat <> 'src2'").withColumn("sha256", F.when(F.col("lang") == "de", "changed").otherwise(F.col("sha256")))
    return incremental.migration_state(s.where("chat <> 'src1'"), on_disk)


# text


@register("o105_normalize", sql("SELECT segment_id, sha256(trim(regexp_replace(regexp_replace(translate(nfc_normalize(text), '‘’‚‛“”„‟', '''''''''\"\"\"\"'), '[\\x{FE00}-\\x{FE0F}]', '', 'g'), '\\s+', ' ', 'g'))) AS normalized_sha256 FROM segment", "segment"))
def o105(spark, sf):
    return view(spark, sf, "segment").select("segment_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("normalized_sha256"))


@register("o106_object_marks", sql("SELECT segment_id, length(replace(text || chr(65532), chr(65532), '')) AS n FROM segment", "segment"))
def o106(spark, sf):
    return view(spark, sf, "segment").select("segment_id", F.length(text.strip_object_marks(F.concat("text", F.lit(text.OBJECT_REPLACEMENT)))).cast("long").alias("n"))


@register("o107_estimate_tokens", sql("SELECT segment_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM segment", "segment"))
def o107(spark, sf):
    return view(spark, sf, "segment").select("segment_id", text.estimate_tokens(F.col("text")).alias("tokens"))


# Units, their costs and sums; a chunk runs from its first unit (of the overlap) to where its sum would exceed the target.
CHUNKS = r"""w AS (SELECT segment_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS whole FROM segment),
u AS (SELECT segment_id, whole, list_filter(list_transform(string_split_regex(whole, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps,
  list_filter(string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM w WHERE whole <> ''),
p AS (SELECT segment_id, flatten(list_transform(CASE WHEN len(ps) < 2 THEN ss ELSE ps END, lambda x: list_transform(range(0, length(x), 6000), lambda i: substr(x, i + 1, 6000)))) AS x FROM u),
q AS (SELECT segment_id, x, len(x) AS n, list_transform(range(0, len(x) + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE list_sum(list_transform(x[1:k], lambda t: (length(t) + 3) // 4)) END) AS s FROM p),
c AS (SELECT segment_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS a, 1 + len(list_filter(range(1, n), lambda j: s[j + 2] <= 1500)) AS e FROM q
  UNION ALL SELECT segment_id, seq + 1, a2, e + 1 + len(list_filter(range(e + 1, n), lambda j: s[j + 2] - s[a2 + 1] <= 1500)) FROM (SELECT c.segment_id, c.seq, c.e, q.n, q.s, c.e - len(list_filter(range(c.a, c.e), lambda j: q.s[c.e + 1] - q.s[j + 1] <= 150)) AS a2 FROM c JOIN q USING (segment_id) WHERE c.e < q.n)),
chunk AS (SELECT segment_id, seq, array_to_string(x[a + 1:e], chr(10) || chr(10)) AS t FROM c JOIN q USING (segment_id))"""


@register("o108_chunks", sql("SELECT segment_id, seq, length(t) AS n_chars, sha256(t) AS chunk_sha256 FROM chunk", "segment", ctes=CHUNKS))
def o108(spark, sf):
    chunks = view(spark, sf, "segment").select("segment_id", F.posexplode(text.chunk_text(F.col("text"))).alias("seq", "chunk"))
    return chunks.select("segment_id", F.col("seq").cast("long").alias("seq"), F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


@register("o109_snippets", sql("SELECT segment_id, CASE WHEN trim(text, ' ' || chr(10) || chr(9)) = '' THEN '—' WHEN length(trim(text, ' ' || chr(10) || chr(9))) > 80 THEN rtrim(substr(trim(text, ' ' || chr(10) || chr(9)), 1, 80), ' ' || chr(10) || chr(9)) || '…' ELSE trim(text, ' ' || chr(10) || chr(9)) END AS snippet FROM segment", "segment"))
def o109(spark, sf):
    return view(spark, sf, "segment").select("segment_id", text.snippet(F.col("text"), 80).alias("snippet"))


@register("o112_reactions", "SELECT event_id, CASE event_type WHEN 'click' THEN '♥' WHEN 'view' THEN '😂' WHEN 'error' THEN '🎉' ELSE event_type END AS symbol FROM events")
def o112(spark, sf):
    from colloquy.session import read_table

    kind = F.when(F.col("event_type") == "click", "loved").when(F.col("event_type") == "view", "laughed").when(F.col("event_type") == "error", "emoji:🎉").otherwise(F.col("event_type"))
    return read_table(spark, sf, "events").select("event_id", text.reaction_symbol(kind).alias("symbol"))


@register("o115_previews", sql("SELECT segment_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS preview FROM segment", "segment"))
def o115(spark, sf):
    return view(spark, sf, "segment").select("segment_id", text.preview(F.col("text")).alias("preview"))


@register("o117_hashes", sql("SELECT segment_id, sha256(text) AS text_sha256 FROM segment", "segment"))
def o117(spark, sf):
    return view(spark, sf, "segment").select("segment_id", ids.sha256_text(F.col("text")).alias("text_sha256"))


@register("o121_document_ids", sql("SELECT segment_id, 'd' || substr(sha256('segment:' || segment_id), 1, 62) AS document_id, 'd' || substr(sha256('attachment_chunk:' || segment_id || ':a' || segment_id || ':pdf_text:0'), 1, 62) AS chunk_id FROM segment", "segment"))
def o121(spark, sf):
    key = F.col("segment_id").cast("string")
    return view(spark, sf, "segment").select("segment_id", ids.segment_document_id(key).alias("document_id"), ids.chunk_document_id(key, F.concat(F.lit("a"), key), F.lit("pdf_text"), F.lit(0)).alias("chunk_id"))


DOCUMENT = "doc AS (SELECT chat_id AS segment_id, 'Chat: owner' || chr(10) || 'Time: t' || chr(10) || '---' || chr(10) || string_agg('line ' || ordinal || ' ' || attachment_id, chr(10) ORDER BY ordinal, attachment_id) || chr(10) AS d FROM line GROUP BY 1)"


@register("o111_export_documents", sql("SELECT segment_id, sha256(d) AS rendered_sha256 FROM doc", "line", ctes=DOCUMENT))
def o111(spark, sf):
    lines = view(spark, sf, "line").select(F.col("chat_id").alias("segment_id"), F.col("ordinal").alias("sent_at"), F.col("attachment_id").alias("message_id"), F.concat_ws(" ", F.lit("line"), F.col("ordinal").cast("string"), F.col("attachment_id").cast("string")).alias("line"))
    heads = lines.select("segment_id", F.lit("Chat: owner\nTime: t").alias("head")).distinct()
    return rendering.render_segments(lines, heads, export=True).select("segment_id", "rendered_sha256")


@register("o116_sample_lines", sql("""SELECT segment_id, array_to_string(list_distinct_keep, '|') AS picks FROM (SELECT segment_id, list_transform(CASE WHEN n = 1 THEN [1] WHEN n = 2 THEN [1, 2] ELSE [1, n // 2 + 1, n] END, lambda i: 'line ' || o[i].a || ' ' || o[i].b) AS list_distinct_keep FROM (SELECT chat_id AS segment_id, count(*) AS n, list({'a': ordinal, 'b': attachment_id} ORDER BY ordinal, attachment_id) AS o FROM line GROUP BY 1))""", "line"))
def o116(spark, sf):
    lines = view(spark, sf, "line").groupBy(F.col("chat_id").alias("segment_id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "attachment_id"))).alias("o"))
    body = F.array_join(F.transform("o", lambda x: F.concat_ws(" ", F.lit("line"), x["ordinal"].cast("string"), x["attachment_id"].cast("string"))), "\n")
    return lines.select("segment_id", F.array_join(rendering.sample_lines(F.concat(F.lit("Chat\n---\n"), body)), "|").alias("picks"))


EXPORTED = DOCUMENT.replace("FROM line GROUP BY 1", "FROM line WHERE flag <> 'R' GROUP BY 1") + """,
ours AS (SELECT c.chat_id AS segment_id, sha256('c' || c.chat_id || 'g' || c.chat_id || 'g' || c.chat_id || 'cfg') AS k FROM chat c WHERE c.chat_id IN (SELECT chat_id FROM direct JOIN allowlist USING (person_id) WHERE text_allowed) AND c.chat_id NOT IN (SELECT chat_id FROM direct LEFT JOIN allowlist USING (person_id) WHERE NOT coalesce(text_allowed, false))),
gate AS (SELECT chat_id AS segment_id, attachment_id FROM line WHERE flag <> 'R' GROUP BY ALL HAVING bool_and(quantity > 5))"""


def _export(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("chat_id").cast("string")
    line = view(spark, sf, "line").withColumnRenamed("sent_at", "shipped_at").withColumn("segment_id", F.col("chat_id"))
    told = line.where("flag <> 'R'")
    lines = told.select("segment_id", F.col("ordinal").alias("sent_at"), F.col("attachment_id").alias("message_id"), F.concat_ws(" ", F.lit("line"), F.col("ordinal").cast("string"), F.col("attachment_id").cast("string")).alias("line"))
    chats = view(spark, sf, "chat").select("chat_id")
    segments = chats.select(F.col("chat_id").alias("segment_id"), "chat_id", ids.stable_key(F.concat(F.lit("c"), key), F.concat(F.lit("g"), key), F.concat(F.lit("g"), key), "cfg").alias("stable_key"))
    heads = segments.select("segment_id", F.lit("Chat: owner\nTime: t").alias("head"))
    direct = view(spark, sf, "direct")
    eligible = access.eligible_chats(chats, direct, {"participant_not_allowed": access.not_allowed(direct, view(spark, sf, "allowlist"))})
    gate = access.attachment_gate(line.select("segment_id", "attachment_id", (F.col("quantity") > 5).alias("allowed"), (F.col("flag") == "R").alias("is_unsent")))
    files = view(spark, sf, "attachment").where("state = 'materialized'")
    chunks = files.select("attachment_id", F.concat(F.lit("a"), F.col("attachment_id").cast("string")).alias("attachment_guid"), F.lit("pdf_text").alias("chunk_kind"), F.lit(0).alias("seq"), F.col("filename").alias("text"))
    return upkeep.desired_documents(segments, lines, heads, eligible, chunks, gate)


@register("o155_desired_documents", sql("""SELECT 'd' || substr(sha256('segment:' || k), 1, 62) AS document_id, segment_id, 'segment' AS kind, sha256(d) AS content_sha256 FROM ours JOIN doc USING (segment_id)
  UNION ALL SELECT 'd' || substr(sha256('attachment_chunk:' || k || ':a' || attachment_id || ':pdf_text:0'), 1, 62), segment_id, 'chunk', sha256('Attachment content (pdf_text, part 1)' || chr(10) || 'Chat: owner' || chr(10) || 'Time: t' || chr(10) || '---' || chr(10) || filename || chr(10)) FROM ours JOIN doc USING (segment_id) JOIN gate USING (segment_id) JOIN attachment USING (attachment_id) WHERE state = 'materialized'""", "line", "attachment", "direct", "allowlist", "chat", ctes=EXPORTED))
def o155(spark, sf):
    return _export(spark, sf).select("document_id", "segment_id", "kind", "content_sha256")


@register("o158_rerendered", sql("""SELECT segment_id, CASE WHEN segment_id IN (SELECT l.chat_id FROM line l JOIN attachment a USING (attachment_id) WHERE a.state = 'error') THEN sha256(d) ELSE 'old' END AS rendered_sha256 FROM doc""", "line", "attachment", ctes=DOCUMENT.replace("|| chr(10) AS d", "AS d")))
def o158(spark, sf):
    lines = view(spark, sf, "line").select(F.col("chat_id").alias("segment_id"), F.col("ordinal").alias("sent_at"), F.col("attachment_id").alias("message_id"), F.concat_ws(" ", F.lit("line"), F.col("ordinal").cast("string"), F.col("attachment_id").cast("string")).alias("line"), "attachment_id")
    stored = lines.select("segment_id").distinct().select("segment_id", F.lit("old").alias("rendered_text"), F.lit("old").alias("rendered_sha256"))
    changed = view(spark, sf, "attachment").where("state = 'error'")
    affected = segments.segments_of_attachments(changed, lines.select("attachment_id", "message_id"), lines.select("message_id", "segment_id"))
    after, _ = segments.rerender(stored, affected, lines, stored.select("segment_id", F.lit("Chat: owner\nTime: t").alias("head")))
    return after.select("segment_id", "rendered_sha256")


# search


@register("o87_o88_bm25", _bm25_sql("with that from", 100))
def o88(spark, sf):
    hits = segment_index(spark, sf).search("with that from").withColumn("score", F.round("score", 6))
    return ranking.ranked(hits, [F.col("score").desc(), F.col("segment_id")], 100).withColumn("rank", F.col("rank").cast("long"))


@register("o88_bm25_without_index", _bm25_sql("with that from", 100))
def o88c(spark, sf):
    hits = lexical.bm25(view(spark, sf, "segment"), "with that from").withColumn("score", F.round("score", 6))
    return ranking.ranked(hits, [F.col("score").desc(), F.col("segment_id")], 100).withColumn("rank", F.col("rank").cast("long"))


@register("o86_routes", sql("""SELECT query_id, raw, CASE WHEN contains(raw, '🎉') THEN 'emoji' WHEN quoted AND length(trim(raw[2:-2])) >= 3 THEN 'trigram' ELSE 'bm25' END AS mode, CASE WHEN contains(raw, '🎉') OR NOT quoted OR trim(raw[2:-2]) = '' THEN raw ELSE trim(raw[2:-2]) END AS phrase FROM (SELECT *, starts_with(raw, '"') AND ends_with(raw, '"') AND length(raw) >= 2 AS quoted FROM asked)""", "bench", ctes="""
asked AS (SELECT query_id, trim(regexp_replace(CASE WHEN length(query_text) < 200 THEN '"' || query_text || '"' WHEN length(query_text) < 300 THEN query_text || ' 🎉' WHEN length(query_text) < 400 THEN '"ab"' ELSE query_text END, '\\s+', ' ', 'g')) AS raw FROM bench)"""))
def o86(spark, sf):
    n, q = F.length("query_text"), F.col("query_text")
    raw = text.collapse_space(F.when(n < 200, F.concat(F.lit('"'), q, F.lit('"'))).when(n < 300, F.concat(q, F.lit(" 🎉"))).when(n < 400, F.lit('"ab"')).otherwise(q))
    mode, phrase = lexical.route_columns(F.col("raw"))
    return view(spark, sf, "bench").select("query_id", raw.alias("raw")).select("query_id", "raw", mode.alias("mode"), phrase.alias("phrase"))


@register("o89_tokenize", sql(f"SELECT segment_id, len(w) AS n, sha256(array_to_string(w, ' ')) AS terms_sha256 FROM (SELECT segment_id, {WORDS} AS w FROM segment)", "segment"))
def o89(spark, sf):
    return view(spark, sf, "segment").select("segment_id", text.tokenize(F.col("text")).alias("w")).select("segment_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("terms_sha256"))


@register("o88_postings", sql(f"SELECT term, count(DISTINCT segment_id) AS df, count(*) AS cf FROM (SELECT segment_id, unnest({WORDS}) AS term FROM segment) GROUP BY 1", "segment"))
def o88b(spark, sf):
    return segment_index(spark, sf).terms


@register("o90_trigram_substring", sql("SELECT segment_id FROM segment WHERE contains(lower(text), 'ing th')", "segment"))
def o90(spark, sf):
    return segment_index(spark, sf, "trigram").search(lexical.route('"ing th"').phrase).select("segment_id")


RANKED = "SELECT segment_id, score, row_number() OVER (ORDER BY score DESC, segment_id) AS rank FROM scored ORDER BY score DESC, segment_id LIMIT 100"


@register("o90_ranked", sql(RANKED, "segment", ctes=_phrase_ctes("ation of th")))
def o90b(spark, sf):
    hits = segment_index(spark, sf, "trigram").search("ation of th").withColumn("score", F.round("score", 6))
    return ranking.ranked(hits, [F.col("score").desc(), F.col("segment_id")], 100).withColumn("rank", F.col("rank").cast("long"))


@register("o90_ranked_without_index", sql(RANKED, "segment", ctes=_phrase_ctes("ation of th")))
def o90c(spark, sf):
    hits = lexical.bm25_of_phrase(view(spark, sf, "segment"), "ation of th").withColumn("score", F.round("score", 6))
    return ranking.ranked(hits, [F.col("score").desc(), F.col("segment_id")], 100).withColumn("rank", F.col("rank").cast("long"))


@register("o91_emoji_substring", sql("SELECT segment_id FROM segment WHERE contains(CASE WHEN lang = 'de' THEN text || ' 🎉' WHEN lang = 'fr' THEN text || ' 🎈' ELSE text END, '🎉')", "segment"))
def o91(spark, sf):
    original = F.when(F.col("lang") == "de", F.concat("text", F.lit(" 🎉"))).when(F.col("lang") == "fr", F.concat("text", F.lit(" 🎈"))).otherwise(F.col("text"))
    asked = lexical.route("🎉")
    return lexical.substring_hits(view(spark, sf, "segment").withColumn("text_original", original), asked.phrase, "text_original", ignore_case=asked.mode != "emoji").select("segment_id")


@register("o72_earliest_match", sql("SELECT chat_id AS segment_id, min(sent_at) AS matched_at FROM message WHERE contains(text, '7') GROUP BY 1 ORDER BY matched_at DESC, 1 LIMIT 20", "message"))
def o72(spark, sf):
    m = view(spark, sf, "message").where(F.col("text").contains("7")).withColumnRenamed("chat_id", "segment_id")
    return ranking.distinct_earliest(m, 20).select("segment_id", "matched_at")


QUERY_VECTOR = "q AS (SELECT vec AS qv FROM vector WHERE segment_id = 7)"
DISTANCE = "round(1 - list_cosine_similarity(CAST(vec AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6)"


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    found = view(spark, sf, "vector").where("segment_id = 7").first()
    return list(found["vec"]) if found else [0.0]


def _distances(spark: SparkSession, sf: str) -> DataFrame:
    target = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf)])
    return view(spark, sf, "vector").withColumn("distance", F.round(vectors.cosine_distance(F.col("vec"), target), 6))


@register("o76_vector_top_k_pruned", sql(f"SELECT segment_id, {DISTANCE} AS distance, row_number() OVER (ORDER BY {DISTANCE}, segment_id) AS rank FROM vector, q ORDER BY distance, segment_id LIMIT 50", "vector", ctes=QUERY_VECTOR))
def o76b(spark, sf):
    index = nearest.write_vectors(view(spark, sf, "vector"), shared_path(spark, "vectors"))
    hits = index.top_k(_query_vector(spark, sf), 50)
    return hits.select("segment_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@register("o76_vector_top_k", sql(f"SELECT segment_id, {DISTANCE} AS distance, row_number() OVER (ORDER BY {DISTANCE}, segment_id) AS rank FROM vector, q ORDER BY distance, segment_id LIMIT 50", "vector", ctes=QUERY_VECTOR))
def o76(spark, sf):
    return ranking.ranked(_distances(spark, sf).select("segment_id", "distance"), [F.col("distance"), F.col("segment_id")], 50).withColumn("rank", F.col("rank").cast("long"))


@register("o93_cosine_distance", sql(f"SELECT segment_id, {DISTANCE} AS distance FROM vector, q", "vector", ctes=QUERY_VECTOR))
def o93(spark, sf):
    return _distances(spark, sf).select("segment_id", "distance")


@register("o51_best_per_segment", sql(f"SELECT chat, min(d) AS distance FROM (SELECT chat, {DISTANCE} AS d FROM vector JOIN segment USING (segment_id), q) GROUP BY 1", "vector", "segment", ctes=QUERY_VECTOR))
def o51(spark, sf):
    return ranking.best_per(_distances(spark, sf).join(view(spark, sf, "segment").select("segment_id", "chat"), "segment_id"), "chat", "distance")


@register("o77_collapse_top_k", sql(f"SELECT chat, min(d) AS distance, row_number() OVER (ORDER BY min(d), chat) AS rank FROM (SELECT chat, {DISTANCE} AS d FROM vector JOIN segment USING (segment_id), q) GROUP BY 1 ORDER BY 2, 1 LIMIT 5", "vector", "segment", ctes=QUERY_VECTOR))
def o77(spark, sf):
    links = view(spark, sf, "segment").select(F.col("segment_id").alias("chunk_id"), "chat")
    hits = _distances(spark, sf).select(F.col("segment_id").alias("chunk_id"), "distance")
    return ranking.collapse_top_k(hits, links, 5, item="chat").withColumn("rank", F.col("rank").cast("long"))


@register("o98_mean_pool", sql("""SELECT label, i, round(a / sqrt(sum(a * a) OVER (PARTITION BY label)), 6) AS component FROM (SELECT label, i, avg(CAST(vec[i] AS DOUBLE)) AS a FROM vector, range(1, 65) r(i) GROUP BY 1, 2)""", "vector"))
def o98(spark, sf):
    pooled = vectors.mean_vectors(view(spark, sf, "vector"), ["label"])
    return pooled.select("label", F.posexplode("vec").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("component"))


@register("o97_fake_embedding", sql("""SELECT query_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY query_id)), 6) AS component FROM (SELECT query_id, i, CAST('0x' || substr(sha256(i || ':doc:' || query_text), 1, 13) AS BIGINT) / 2251799813685248.0 - 1 AS x FROM bench, range(0, 32) r(i))""", "bench"))
def o97(spark, sf):
    v = view(spark, sf, "bench").select("query_id", F.posexplode(vectors.fake_embedding(F.concat(F.lit("doc:"), "query_text"), 32)).alias("i", "x"))
    return v.select("query_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("component"))


@register("o09_vector_literals", sql("SELECT segment_id, i, round(CAST(vec[i] AS DOUBLE), 6) AS x FROM vector, range(1, 65) r(i)", "vector"))
def o09(spark, sf):
    back = vectors.from_literal(vectors.to_literal(F.col("vec")))
    return view(spark, sf, "vector").select("segment_id", F.posexplode(back).alias("i", "x")).select("segment_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


RRF = "ch AS (SELECT 1 AS c, segment_id, row_number() OVER (ORDER BY n_chars DESC, segment_id) AS rank FROM segment UNION ALL SELECT 2, segment_id, row_number() OVER (ORDER BY sha256(text), segment_id) FROM segment), top AS (SELECT * FROM ch WHERE rank <= 100)"


def _channels(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "segment")
    a = ranking.ranked(s, [F.col("n_chars").desc(), F.col("segment_id")], 100).select(F.lit(1).alias("channel"), "segment_id", "rank")
    b = ranking.ranked(s, [F.sha2("text", 256), F.col("segment_id")], 100).select(F.lit(2).alias("channel"), "segment_id", "rank")
    return a.unionByName(b)


@register("o52_rrf", sql("SELECT segment_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS channels FROM top GROUP BY 1", "segment", ctes=RRF))
def o52(spark, sf):
    return ranking.fuse(_channels(spark, sf)).select("segment_id", F.round("score", 9).alias("score"), "channels")


TOKENS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'))"
JACCARD = f"round(CASE WHEN len({TOKENS('text')}) = 0 THEN 0 ELSE len(list_intersect({TOKENS('text')}, {TOKENS('query_text')})) / len(list_distinct(list_concat({TOKENS('text')}, {TOKENS('query_text')}))) END, 6)"


def _asked(spark: SparkSession, sf: str) -> Column:
    """The text of one query of the benchmark; null if it is not there."""
    found = view(spark, sf, "bench").where("query_id = 3").first()
    return F.lit(found["query_text"] if found else None).cast("string")


@register("o95_jaccard", sql(f"SELECT segment_id, {JACCARD} AS score FROM segment, (SELECT query_text FROM bench WHERE query_id = 3)", "segment", "bench"))
def o95(spark, sf):
    q = _asked(spark, sf)
    score = text.jaccard(F.array_distinct(text.words(F.col("text"))), F.array_distinct(text.words(q)))
    return view(spark, sf, "segment").select("segment_id", F.round(score, 6).alias("score"))


@register("o78_rerank_pool", sql(f"SELECT segment_id, row_number() OVER (ORDER BY score DESC, rank) AS rank FROM (SELECT segment_id, rank, {JACCARD} AS score FROM top JOIN segment USING (segment_id), (SELECT query_text FROM bench WHERE query_id = 3) WHERE c = 1 AND rank <= 50) ORDER BY score DESC, top_rank LIMIT 10".replace("top_rank", "rank"), "segment", "bench", ctes=RRF).replace("row_number() OVER (ORDER BY score DESC, rank) AS rank FROM (SELECT segment_id, rank,", "row_number() OVER (ORDER BY score DESC, pr) AS rank FROM (SELECT segment_id, rank AS pr,").replace("ORDER BY score DESC, rank LIMIT 10", "ORDER BY score DESC, pr LIMIT 10"))
def o78(spark, sf):
    q = _asked(spark, sf)
    top = _channels(spark, sf).where("channel = 1 and rank <= 50").join(view(spark, sf, "segment").select("segment_id", "text"), "segment_id")
    return ranking.rerank(top, q, limit=10).select("segment_id", F.col("rank").cast("long").alias("rank"))


@register("o96_passthrough", sql("SELECT segment_id, CAST(101 - rank AS DOUBLE) AS rerank_score FROM top WHERE c = 1", "segment", ctes=RRF))
def o96(spark, sf):
    return ranking.passthrough(_channels(spark, sf).where("channel = 1")).select("segment_id", "rerank_score")


RAW_DISTANCE = "1 - list_cosine_similarity(CAST(vec AS DOUBLE[]), CAST(qv AS DOUBLE[]))"
SEARCH = _bm25_ctes("with that from", None) + f""", {QUERY_VECTOR},
tch AS (SELECT segment_id, row_number() OVER (ORDER BY score DESC, segment_id) AS rank FROM scored QUALIFY rank <= 100),
vch AS (SELECT segment_id, row_number() OVER (ORDER BY {RAW_DISTANCE}, segment_id) AS rank FROM vector SEMI JOIN segment USING (segment_id), q QUALIFY rank <= 100),
fused AS (SELECT segment_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM tch UNION ALL SELECT * FROM vch) GROUP BY 1),
pooled AS (SELECT segment_id, score, row_number() OVER (ORDER BY score DESC, segment_id) AS pr FROM fused QUALIFY pr <= 50),
judged AS (SELECT segment_id, score, pr, {JACCARD} AS jac FROM pooled JOIN segment USING (segment_id), (SELECT 'with that from' AS query_text))"""
SEARCH_SQL = sql("SELECT segment_id, row_number() OVER (ORDER BY jac DESC, pr) AS rank, round(score, 6) AS score, jac AS rerank_score FROM judged ORDER BY jac DESC, pr LIMIT 10", "segment", "vector", ctes=SEARCH).replace("FROM vector SEMI JOIN segment USING (segment_id), q QUALIFY", "FROM (SELECT * FROM vector SEMI JOIN segment USING (segment_id)), q QUALIFY")


def _other_search_sql(ctes: str, order: str, asked: str) -> str:
    """``SEARCH_SQL`` of another query: its first channel's rows and their order."""
    return SEARCH_SQL.replace(_bm25_ctes("with that from", None), ctes).replace("row_number() OVER (ORDER BY score DESC, segment_id) AS rank FROM scored", f"row_number() OVER (ORDER BY {order}, segment_id) AS rank FROM scored").replace("'with that from' AS query_text", f"'{asked}' AS query_text")


def _search(spark: SparkSession, sf: str, filters: access.Filters, query: str = "with that from") -> DataFrame:
    s = view(spark, sf, "segment").withColumnsRenamed({"chat": "chat_id"}).withColumn("started_at", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, cast(segment_id as int))"))
    original = F.when(F.col("lang") == "de", F.concat("text", F.lit(" 🎉"))).otherwise(F.col("text"))
    originals = s.select("segment_id", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, n_chars)").alias("sent_at"), original.alias("text_original"))
    mode = lexical.route(query).mode
    tables = SearchTables(
        segments=s, vectors=view(spark, sf, "vector"), originals=originals, text_index=segment_index(spark, sf) if mode == "bm25" else None, text_trigrams=segment_index(spark, sf, "trigram") if mode == "trigram" else None,
    )
    return hybrid_search(tables, query, _query_vector(spark, sf), filters=filters, limit=10)


@register("o94_quoted_search", _other_search_sql(_phrase_ctes("tion of th", None), "score DESC", "tion of th"))
def o94c(spark, sf):
    return _search(spark, sf, access.Filters(), '"tion of th"')


@register("o94_emoji_search", _other_search_sql("scored AS (SELECT segment_id, n_chars AS score FROM segment WHERE lang = 'de' OR contains(text, '🎉'))", "score DESC", "🎉"))
def o94d(spark, sf):
    return _search(spark, sf, access.Filters(), "🎉")


@register("o94_hybrid_search", SEARCH_SQL)
def o94(spark, sf):
    return _search(spark, sf, access.Filters(after="2024-01-01"))


FILTERED = "(SELECT segment_id FROM segment WHERE lang IN ('en', 'fr') AND chat <> 'src3')"


@register("o94_hybrid_search_filtered", SEARCH_SQL.replace("row_number() OVER (ORDER BY score DESC, segment_id) AS rank FROM scored QUALIFY", f"row_number() OVER (ORDER BY score DESC, segment_id) AS rank FROM scored WHERE segment_id IN {FILTERED} QUALIFY").replace("(SELECT * FROM vector SEMI JOIN segment USING (segment_id))", f"(SELECT * FROM vector WHERE segment_id IN {FILTERED})"))
def o94b(spark, sf):
    return _search(spark, sf, access.Filters(extra=(F.col("lang").isin("en", "fr"), F.col("chat_id") != "src3")))


@register("o75_authorised_top_k", sql("SELECT segment_id, row_number() OVER (ORDER BY score DESC, segment_id) AS rank FROM scored WHERE segment_id IN (SELECT segment_id FROM segment WHERE chat < 'src3') ORDER BY score DESC, segment_id LIMIT 40", "segment", ctes=_bm25_ctes("with that from", None)))
def o75(spark, sf):
    hits = segment_index(spark, sf).search("with that from").join(view(spark, sf, "segment").where("chat < 'src3'").select("segment_id"), "segment_id", "left_semi")
    return ranking.ranked(hits, [F.col("score").desc(), F.col("segment_id")], 40).select("segment_id", F.col("rank").cast("long").alias("rank"))


@register("o101_attachment_text", sql("SELECT attachment_id, filename FROM attachment WHERE sha256('attachment:' || attachment_id) = sha256('attachment:37') AND attachment_id IN (SELECT attachment_id FROM line WHERE chat_id IN (SELECT chat_id FROM direct JOIN allowlist USING (person_id) WHERE text_allowed))", "attachment", "line", "direct", "allowlist"))
def o101(spark, sf):
    visible = view(spark, sf, "direct").join(view(spark, sf, "allowlist").where("text_allowed"), "person_id", "left_semi").select(F.col("chat_id").alias("segment_id"))
    keyed = view(spark, sf, "attachment").withColumn("attachment_key", ids.derived_key("attachment", F.col("attachment_id").cast("string")))
    wanted = hashlib.sha256(b"attachment:37").hexdigest()
    links = view(spark, sf, "line").select("attachment_id", F.col("chat_id").alias("segment_id"))
    return upkeep.attachment_text(keyed, links, visible, wanted).select("attachment_id", "filename")


@register("o134_late_edits", sql("SELECT message_id FROM message WHERE kind = 'error' AND sent_at > TIMESTAMP '2024-01-20'", "message"))
def o134(spark, sf):
    m = view(spark, sf, "message").withColumn("retracted_at", F.when(F.col("is_unsent"), F.col("sent_at"))).withColumn("edited_at", F.lit(None).cast("timestamp_ntz"))
    return incremental.incremental_scan(m, 1 << 60, F.lit("2024-01-20").cast("timestamp_ntz"), "message_id").select("message_id")


# evaluation

GRADES = "g AS (SELECT segment_id % 40 AS query_id, segment_id, max(grade) AS grade FROM label GROUP BY 1, 2), r AS (SELECT segment_id % 40 AS query_id, segment_id, row_number() OVER (PARTITION BY segment_id % 40 ORDER BY n_chars DESC, segment_id) AS rank FROM segment), r2 AS (SELECT segment_id % 40 AS query_id, segment_id, row_number() OVER (PARTITION BY segment_id % 40 ORDER BY n_chars, segment_id) AS rank FROM segment)"


def _metrics_cte(name: str, runs: str, k: int = 10) -> str:
    return f"""{name} AS (SELECT query_id, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg END AS ndcg, CASE WHEN rel > 0 THEN CAST(coalesce(hit, 0) AS DOUBLE) / rel END AS recall, coalesce(1.0 / nullif(fst, 0), 0) AS rr, fst IS NOT NULL AS success, coalesce(judged, 0) AS judged, coalesce(win, 0) AS window_size FROM bench
  LEFT JOIN (SELECT query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade >= 1) AS hit, min(CASE WHEN grade >= 1 THEN rank END) AS fst, count(grade) AS judged, count(*) AS win FROM {runs} LEFT JOIN g USING (query_id, segment_id) WHERE rank <= {k} GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT query_id, sum((pow(2, grade) - 1) / log2(ir + 1)) FILTER (ir <= {k}) AS idcg, count(*) FILTER (grade >= 1) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, segment_id) AS ir FROM g) GROUP BY 1) USING (query_id))"""


METRICS = GRADES + ", " + _metrics_cte("m", "r") + ", " + _metrics_cte("m2", "r2")


def _grades(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.highest_grades(view(spark, sf, "label").withColumn("query_id", F.col("segment_id") % 40))


def _run(spark: SparkSession, sf: str, descending: bool = True) -> DataFrame:
    s = view(spark, sf, "segment").select("segment_id", "n_chars", (F.col("segment_id") % 40).alias("query_id"))
    return ranking.ranked(s, [F.col("n_chars").desc() if descending else F.col("n_chars"), F.col("segment_id")], within=["query_id"]).select("query_id", "segment_id", "rank")


def _metrics(spark: SparkSession, sf: str, descending: bool = True) -> DataFrame:
    return evaluation.query_metrics(view(spark, sf, "bench"), _run(spark, sf, descending), _grades(spark, sf), 10)


@register("o53_highest_grades", sql("SELECT query_id, segment_id, CAST(grade AS INTEGER) AS grade FROM g", "label", "segment", ctes=GRADES))
def o53(spark, sf):
    return _grades(spark, sf)


@register("o103_query_metrics", sql("SELECT query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(rr, 6) AS rr, success, judged, window_size FROM m", "bench", "label", "segment", ctes=METRICS))
def o103(spark, sf):
    return _metrics(spark, sf).withColumns({c: F.round(c, 6) for c in ("ndcg", "recall", "rr")})


@register("o74_ndcg", sql("SELECT query_id, round(ndcg, 6) AS ndcg FROM m WHERE ndcg IS NOT NULL", "bench", "label", "segment", ctes=METRICS))
def o74(spark, sf):
    return _metrics(spark, sf).where("ndcg is not null").select("query_id", F.round("ndcg", 6).alias("ndcg"))


@register("o54_roll_up", sql("SELECT round(avg(ndcg), 6) AS ndcg_mean, round(avg(recall), 6) AS recall_mean, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(sum(judged) / sum(window_size), 6) AS judged_coverage, count(ndcg) AS scored_queries, count(*) AS total_queries FROM m", "bench", "label", "segment", ctes=METRICS))
def o54(spark, sf):
    return evaluation.roll_up(_metrics(spark, sf)).withColumns({c: F.round(c, 6) for c in ("ndcg_mean", "recall_mean", "mrr", "success_rate", "judged_coverage")})


@register("o42_run_diff", sql("""SELECT query_id, CASE WHEN a.query_id IS NOT NULL AND b.query_id IS NOT NULL THEN round(b.ndcg - a.ndcg, 6) END AS ndcg_delta, CASE WHEN a.query_id IS NOT NULL AND b.query_id IS NOT NULL THEN round(b.recall - a.recall, 6) END AS recall_delta, CASE WHEN a.query_id IS NOT NULL AND b.query_id IS NOT NULL THEN round(b.rr - a.rr, 6) END AS rr_delta,
  CASE WHEN b.query_id IS NULL THEN 'a' WHEN a.query_id IS NULL THEN 'b' END AS only_in FROM (SELECT * FROM m WHERE window_size > 0) a FULL JOIN (SELECT * FROM m2 WHERE success) b USING (query_id)""", "bench", "label", "segment", ctes=METRICS))
def o42(spark, sf):
    out = evaluation.diff_runs(_metrics(spark, sf).where("window_size > 0"), _metrics(spark, sf, False).where("success"))
    return out.withColumns({f"{c}_delta": F.round(f"{c}_delta", 6) for c in ("ndcg", "recall", "rr")})


@register("o55_gates", sql("SELECT q AS n_queries, j AS n_judgments, wp AS n_with_positive, p AS n_positive, ng AS n_negative, concat_ws(',', CASE WHEN q < 30 THEN 'too_few_queries' END, CASE WHEN j < 100 THEN 'too_few_judgments' END, CASE WHEN wp < 25 THEN 'too_few_positives' END, CASE WHEN p = 0 OR ng = 0 THEN 'one_sided' END) AS reasons, NOT (q < 30 OR j < 100 OR wp < 25 OR p = 0 OR ng = 0) AS passed FROM (SELECT count(*) AS q FROM bench), (SELECT count(*) AS j, count(DISTINCT CASE WHEN grade >= 1 THEN query_id END) AS wp, count(*) FILTER (grade >= 1) AS p, count(*) FILTER (grade < 1) AS ng FROM g)", "bench", "label", "segment", ctes=GRADES))
def o55(spark, sf):
    return evaluation.gates(view(spark, sf, "bench"), _grades(spark, sf))


@register("o84_pool", sql("""SELECT query_id, segment_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, row_number() OVER (PARTITION BY query_id ORDER BY sha256('9|' || query_id || '|' || segment_id), segment_id) AS position FROM (SELECT 'a' AS source, * FROM r WHERE rank <= 5 UNION ALL SELECT 'b', * FROM r2 WHERE rank <= 5) GROUP BY 1, 2""", "label", "segment", ctes=GRADES))
def o84(spark, sf):
    runs = _run(spark, sf).withColumn("source", F.lit("a")).unionByName(_run(spark, sf, False).withColumn("source", F.lit("b")))
    return evaluation.pool(runs, 5, 9).withColumn("position", F.col("position").cast("long"))


@register("o102_hosted_fold", sql("SELECT query_id, segment_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), segment_id) AS rank FROM (SELECT query_id, segment_id // 3 AS segment_id, rank FROM r) GROUP BY 1, 2", "label", "segment", ctes=GRADES))
def o102(spark, sf):
    hits = _run(spark, sf).select("query_id", F.col("segment_id").alias("document_id"), "rank")
    documents = view(spark, sf, "segment").select(F.col("segment_id").alias("document_id"), F.expr("segment_id div 3").alias("segment_id"))
    return evaluation.fold_hosted(hits, documents).select("query_id", "segment_id", F.col("rank").cast("long").alias("rank"))
