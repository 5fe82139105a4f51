"""Attachments: enrichment texts, file states, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Why an attachment's file is not there, by its state.
GAP_REASONS = {"dataless": "waiting", "error": "failed", "materializing": "interrupted", "missing": "gave_up"}
# The category of each state.
CATEGORIES = {"dataless": "dataless_retrying", "materializing": "dataless_retrying", "missing": "remote_missing", "error": "error", "unsupported": "unsupported"}


def pivot_enrichments(rows: DataFrame, keys: tuple[str, ...] = ("attachment_id",)) -> DataFrame:
    """One row per attachment: pdf_text, caption, ocr_text, transcript. Text on frames wins over that of a still."""
    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("text")))

    done = rows.where("state = 'done'")
    return done.groupBy(*keys).agg(of("pdf_text").alias("pdf_text"), of("caption").alias("caption"), F.coalesce(of("frame_ocr"), of("ocr")).alias("ocr_text"), of("transcript").alias("transcript"))


def reconcile_files(rows: DataFrame, on_disk: str = "on_disk") -> DataFrame:
    """Adds ``present``, ``reason`` and ``category`` from state and whether the file is there."""
    present = (F.col("state") == "materialized") & F.coalesce(on_disk, F.lit(False))
    table = F.create_map(*[F.lit(v) for p in GAP_REASONS.items() for v in p])
    kinds = F.create_map(*[F.lit(v) for p in CATEGORIES.items() for v in p])
    reason = F.when(F.col("state") == "materialized", "file_gone").otherwise(F.coalesce(table[F.col("state")], F.concat(F.lit("unknown_state:"), F.coalesce("state", F.lit("null")))))
    category = F.when(F.col("state") == "materialized", "error").otherwise(F.coalesce(kinds[F.col("state")], F.lit("error")))
    return rows.select("*", present.alias("present"), F.when(~present, reason).alias("reason"), F.when(~present, category).alias("category"))


def completeness(rows: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Present and total, and their ratio; of nothing everything is there."""
    grouped = rows.groupBy(*(by or []))
    out = grouped.agg(F.count_if("present").alias("present"), F.count("*").alias("total"))
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.try_divide(F.col("present").cast("double"), F.col("total"))))


def sample_for_integrity(rows: DataFrame, n: int, seed: int, key: str = "attachment_id", strata: str | None = None) -> DataFrame:
    """A reproducible sample of ``n`` rows, or ``n`` of each stratum."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    if strata is None:
        return rows.orderBy(order, key).limit(n)
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(strata).orderBy(order, key))).where(F.col("_n") <= n).drop("_n")


def within_limits(rows: DataFrame, most: dict[str, int]) -> DataFrame:
    """Adds ``refused``: the first ceiling (bytes, pages, seconds) that a row exceeds; such tasks fail for good."""
    refused = F.lit(None).cast("string")
    for column, limit in reversed(most.items()):
        refused = F.when(F.col(column) > limit, F.lit(f"too_many_{column}")).otherwise(refused)
    return rows.withColumn("refused", refused)


def frame_paths(detail: Column) -> tuple[Column, Column]:
    """``(paths, hash)`` of the frames in an enrichment's JSON detail, sorted."""
    parsed = F.from_json(detail, "frames array<struct<timestamp_seconds: double, text: string, path: string>>")
    paths = F.array_sort(F.filter(F.coalesce(F.transform(parsed["frames"], lambda f: f["path"]), F.array().cast("array<string>")), lambda p: p.isNotNull()))
    return paths, F.sha2(F.array_join(paths, "\n"), 256)


def task_outcome(kind: Column, text: Column, failure: Column, attempts: Column, most_attempts: int) -> Column:
    """done, skipped (nothing to read), retry or failed."""
    return (
        F.when(failure == "permanent", "failed").when((failure == "transient") & (attempts + 1 >= most_attempts), "failed").when(failure == "transient", "retry")
        .when(kind.isin("caption", "ocr", "frame_ocr") & (F.coalesce(F.trim(text), F.lit("")) == ""), "skipped").otherwise("done")
    )
