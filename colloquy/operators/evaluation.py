"""Scoring of retrieval runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELEVANT = 1
#: What an evaluation must have at least to count: queries, judgments, queries with a positive.
LEAST_QUERIES, LEAST_JUDGMENTS, LEAST_WITH_POSITIVE = 30, 100, 25


def highest_grades(labels: DataFrame, query: str = "query_id", item: str = "segment_id", grade: str = "grade") -> DataFrame:
    """Labels whose anchors fall into one item: the highest grade wins; anchors without an item do not count."""
    return labels.where(F.col(item).isNotNull()).groupBy(query, item).agg(F.max(grade).alias(grade))


def resolve_labels(labels: DataFrame, messages: DataFrame, members: DataFrame, query: str = "query_id", anchor: str = "anchor_guid", grade: str = "grade", item: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """``(grades, unresolved)``: labels name messages, which are looked up in the segments of now.

    ``messages`` has message_id and source_guid, ``members`` message_id and the
    segment. The grades are ``highest_grades`` of what is found; ``unresolved``
    ``(query, labels, unresolved)`` counts for every query the labels, and those
    whose message is gone, or in no segment.
    """
    where = messages.where(F.col("source_guid").isNotNull()).select(F.col("source_guid").alias(anchor), "message_id").join(members.select("message_id", item), "message_id").drop("message_id")
    found = labels.select(query, anchor, grade).join(where, anchor, "left")
    counts = found.groupBy(query).agg(F.count("*").alias("labels"), F.count_if(F.col(item).isNull()).alias("unresolved"))
    return highest_grades(found, query, item, grade), counts


def query_metrics(queries: DataFrame, ranked: DataFrame, grades: DataFrame, k: int, query: str = "query_id", item: str = "segment_id") -> DataFrame:
    """nDCG, pooled recall, reciprocal rank, success and judged coverage at ``k`` of every query.

    No labels, or none above 0: no nDCG; no relevant label: no recall; both null.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    discount = lambda r: F.log2(r + 1)
    top = ranked.where(F.col("rank") <= k).join(grades, [query, item], "left")
    hits = top.groupBy(query).agg(
        F.sum(gain(F.coalesce("grade", F.lit(0))) / discount(F.col("rank"))).alias("dcg"), F.count_if(F.col("grade") >= RELEVANT).alias("relevant_hits"),
        F.min(F.when(F.col("grade") >= RELEVANT, F.col("rank"))).alias("first_hit"), F.count("grade").alias("judged"), F.count("*").alias("window_size"),
    )
    ideal_rank = Window.partitionBy(query).orderBy(F.col("grade").desc(), item)
    ideal = grades.withColumn("ideal", F.row_number().over(ideal_rank)).groupBy(query).agg(
        F.sum(F.when(F.col("ideal") <= k, gain(F.col("grade")) / discount(F.col("ideal")))).alias("idcg"), F.count_if(F.col("grade") >= RELEVANT).alias("relevant")
    )
    rows = queries.select(query).join(hits, query, "left").join(ideal, query, "left")
    return rows.select(
        query, F.try_divide(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0))), F.col("idcg")).alias("ndcg"),
        F.try_divide(F.when(F.col("relevant") > 0, F.coalesce("relevant_hits", F.lit(0))).cast("double"), F.col("relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr"), F.col("first_hit").isNotNull().alias("success"),
        F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("window_size", F.lit(0)).alias("window_size"),
    )


def roll_up(metrics: DataFrame) -> DataFrame:
    """A run's means: nDCG and recall over queries that have them, the rest over all."""
    return metrics.agg(
        F.avg("ndcg").alias("ndcg_mean"), F.avg("recall").alias("recall_mean"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"), F.coalesce(F.try_divide(F.sum("judged").cast("double"), F.sum("window_size")), F.lit(0.0)).alias("judged_coverage"),
        F.count("ndcg").alias("scored_queries"), F.count("*").alias("total_queries"),
    )


def diff_runs(a: DataFrame, b: DataFrame, query: str = "query_id") -> DataFrame:
    """Per query of both runs the change of each metric; those of one run only carry ``only_in``."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(query, *[F.col(c).alias(f"{c}_{name}") for c in ("ndcg", "recall", "rr")], F.lit(True).alias(f"in_{name}"))

    both = side(a, "a").join(side(b, "b"), query, "full_outer")
    only = F.when(F.col("in_b").isNull(), "a").when(F.col("in_a").isNull(), "b")
    return both.select(query, *[F.when(only.isNull(), F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_delta") for c in ("ndcg", "recall", "rr")], only.alias("only_in"))


def gates(queries: DataFrame, grades: DataFrame, query: str = "query_id") -> DataFrame:
    """One row: what there is, and the reasons for which that is not enough."""
    q = queries.agg(F.count("*").alias("n_queries"))
    g = grades.agg(F.count("*").alias("n_judgments"), F.countDistinct(F.when(F.col("grade") >= RELEVANT, F.col(query))).alias("n_with_positive"), F.count_if(F.col("grade") >= RELEVANT).alias("n_positive"), F.count_if(F.col("grade") < RELEVANT).alias("n_negative"))
    both = q.crossJoin(g)  # one row each
    tests = [(F.col("n_queries") < LEAST_QUERIES, "too_few_queries"), (F.col("n_judgments") < LEAST_JUDGMENTS, "too_few_judgments"), (F.col("n_with_positive") < LEAST_WITH_POSITIVE, "too_few_positives"), ((F.col("n_positive") == 0) | (F.col("n_negative") == 0), "one_sided")]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, name) for c, name in tests])), ",")
    return both.select("*", reasons.alias("reasons"), (reasons == "").alias("passed"))


def pool(runs: DataFrame, top_n: int, seed: int | str, query: str = "query_id", item: str = "segment_id") -> DataFrame:
    """Items to judge: the first ``top_n`` of every source, once, in an order that the seed fixes and no source favours."""
    joined = runs.where(F.col("rank") <= top_n).groupBy(query, item).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    shuffled = Window.partitionBy(query).orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(query).cast("string"), F.col(item).cast("string")), 256), item)
    return joined.withColumn("position", F.row_number().over(shuffled))


def fold_hosted(hits: DataFrame, documents: DataFrame, query: str = "query_id", item: str = "segment_id") -> DataFrame:
    """Hits on documents as hits on the items that they belong to: the first of each counts, ranks close up."""
    first = hits.join(documents, "document_id").groupBy(query, item).agg(F.min("rank").alias("hit_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("hit_rank", item)))


def variants(switches: Sequence[str]) -> list[dict[str, bool]]:
    """All settings of the switches, off first."""
    return [{s: bool(i >> j & 1) for j, s in enumerate(switches)} for i in range(2 ** len(switches))]
