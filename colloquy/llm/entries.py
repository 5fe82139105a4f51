"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import dac, fim, htmlrender, langid, periods, pii, simhash, suffixes, toxicity, trie_bpe, urlgraph, vectorgraph, winnow
from colloquy.llm.common import read_table, shared_path

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file, which every machine has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Rules that op2 is asked for.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Key of the surrogates in op5 and the pipeline; a production run passes its own secret.
PII_KEY = "colloquy-example-key"


def op1_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vectorgraph.links_and_components(read_table(spark, sf_dir, "embeddings"))
    return done.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = urlgraph.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)
    return done.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return done.withColumnRenamed("id", "doc_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    files = dac.write_tokens(read_table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    return dac.read_digests(files).withColumnRenamed("id", "doc_id")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", F.size("pii_entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("pii_entities.kind")), ",").alias("kinds"), "text", F.col("pii_entities").alias("entities"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = trie_bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digests_only=True)
    return done.withColumnRenamed("id", "doc_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = htmlrender.extract(read_table(spark, sf_dir, "pages"))
    return done.select(F.col("id").alias("page_id"), "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = langid.identify_held_out(read_table(spark, sf_dir, "documents"))
    return done.withColumnsRenamed({"id": "doc_id", "lang_score": "score"})


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = winnow.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return done.select(
        F.col("id").alias("doc_id"), "n_words", winnow.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        winnow.digest().alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"))
    done = periods.periodic_runs(docs).withColumn("best", periods.longest())
    return done.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        periods.runs_digest().alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.fill_in_middle(read_table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return done.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 10) AS n, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, s.n, w, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, sizes s WHERE len(w) >= s.n)),
met AS (SELECT rid, n, i, item_id FROM grams JOIN windows USING (n, g)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM met)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT rid, item_id FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p AS (SELECT doc_id, t, u, len(u) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p),
s AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM s
"""


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
walk(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT walk.u, links.w FROM walk JOIN links ON walk.w = links.u),
least AS (SELECT u, min(w) AS c FROM walk GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links, coalesce(least.c, vec_id) AS component_id, coalesce(vec_id = coalesce(least.c, vec_id), false) AS kept
FROM embeddings LEFT JOIN counts ON counts.u = vec_id LEFT JOIN least ON least.u = vec_id
"""


def op2_sql() -> str:
    """The rules, trust and distrust in SQL, a step for each round."""
    rule = verdict = "NULL"
    for kind, text in sorted(URL_RULES, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    lower = f"'{urlgraph.UPPER}', '{urlgraph.LOWER}'"
    link, unseen = urlgraph.LINK.replace("'", "''"), urlgraph.UNSEEN
    keep, damping, n = 1 - urlgraph.DAMPING, urlgraph.DAMPING, urlgraph.ROUNDS
    steps = ["t_0 AS (SELECT host, good AS mass, CAST(1 AS DOUBLE) AS whole, host IN (SELECT src FROM shares) AS gives FROM hosts)", "d_0 AS (SELECT host, bad AS value FROM hosts)"]
    for i in range(1, n + 1):
        steps.append(
            f"t_{i} AS MATERIALIZED (SELECT host, {keep} * good + {damping} * (CASE WHEN gives THEN 0 ELSE mass END + coalesce(m, 0)) AS mass, {keep} + {damping} * (CASE WHEN gives THEN 0 ELSE whole END + coalesce(w, 0)) AS whole, gives"
            f" FROM hosts JOIN t_{i - 1} USING (host) LEFT JOIN (SELECT dst AS host, sum(mass * share) AS m, sum(whole * share) AS w FROM t_{i - 1} JOIN shares ON host = src GROUP BY dst) USING (host))"
        )
        steps.append(f"d_{i} AS MATERIALIZED (SELECT host, bad + (1 - bad) * {damping} * coalesce(m, 0) AS value FROM hosts LEFT JOIN (SELECT src AS host, sum(value * share) AS m FROM shares JOIN d_{i - 1} ON host = dst GROUP BY src) USING (host))")
    return f"""
WITH a AS (SELECT page_id, regexp_replace(html, '{unseen}', ' ', 'g') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {lower}), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
j AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS own FROM p),
links AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {lower}) AS dst FROM p) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
shares AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM links),
hosts AS (SELECT host, sum(good) AS good, sum(bad) AS bad FROM (SELECT host, avg(CASE WHEN own = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN own = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM j GROUP BY host
  UNION ALL SELECT DISTINCT src, 0.0, 0.0 FROM links UNION ALL SELECT DISTINCT dst, 0.0, 0.0 FROM links) GROUP BY host),
{", ".join(steps)}
SELECT page_id, j.host, path, rule, coalesce(own, CASE WHEN d.value - t.mass / t.whole > {urlgraph.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN t_{n} t ON t.host = j.host JOIN d_{n} d ON d.host = j.host
"""


def queries() -> dict[str, Query]:
    return {
        "op1_vector_near_dedup": op1_vector_near_dedup,
        "op2_url_filter": op2_url_filter,
        "op3_toxicity": op3_toxicity,
        "op4_token_files": op4_token_files,
        "op5_pii_surrogates": op5_pii_surrogates,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_html_text": op7_html_text,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_language_id": op9_language_id,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_near_dedup": OP1_SQL, "op2_url_filter": op2_sql(), "op10_benchmark_decontamination": OP10_SQL, "op12_fill_in_middle": OP12_SQL}
