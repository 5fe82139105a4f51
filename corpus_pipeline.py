"""The corpus pipeline.

Five stages turn the table of documents into token ids: language identification
drops documents without an identifiable language; of each group of texts whose
five-word shingles are similar to 0.8 or more one stays (multi-index hashing of
SimHash fingerprints finds the first links, an exact set join the rest);
documents that hold a benchmark passage go; personal data get surrogates; what
is left is encoded and decoded.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows of
``docs``, the Parquet that its predecessor wrote. All but the last return the
columns of the input. A null text has no language and goes in the first stage;
repeated rows are near-duplicates of each other; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import langid, pii, shingles, trie_bpe, winnow
from colloquy.llm.common import cut_small, drop_path, held_out, read_table, shared_path
from colloquy.llm.entries import PII_KEY, tokenizer_file

#: Documents whose best cosine with any language is below this are no text of a known language.
LEAST_LANGUAGE_SCORE = 0.02

#: No SQL for the whole: stages 1, 2, 4 and 5 are not expressible in it.
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with an identifiable language; profiles are learned from the rows that are not held out."""
    names, prototypes = langid.learn(docs, ~held_out(F.col("doc_id")))
    done = langid.identify(docs, names, prototypes)
    return done.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each component of similar texts.

    Of repeated rows of that id the least by a hash of its columns stays; of rows
    without an id one for each text.
    """
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    labels = cut_small(shingles.near_copies(named))
    gone = labels.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    # What goes is sent to every task while it is few; texts are not shuffled then.
    kept = named.join(F.broadcast(gone) if gone.count() <= shingles.SENT else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = labels.where("id = component").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("copies")).where("copies > 1").select("doc_id")

    def least(rows: DataFrame, key: str) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        hashed = rows.select(F.col(key).alias("key"), whole.alias("row"), F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256).alias("h"))
        return hashed.groupBy("key").agg(F.min_by("row", "h").alias("row")).select("row.*")

    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
        kept = once.unionByName(least(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns), "doc_id"))
    return kept if nameless.isEmpty() else kept.unionByName(least(nameless, "text"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no window of a benchmark item occurs; rows are judged one by one, whatever their ids."""
    return winnow.without_hits(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give personal data keyed surrogates; ``n_chars`` follows the new text."""
    done = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode each text: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    done = trie_bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"), digests_only=True)
    return done.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_passages),
    ("personal_data", replace_personal_data),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``.

    What each leaves is written to the shared folder and read again; it goes when
    the next has written its own, and the last when the application ends.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = shared_path(spark, f"stage-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
