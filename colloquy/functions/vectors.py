"""Column functions on vectors (arrays of numbers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a.cast("array<double>"), lambda x: x / length)).otherwise(a.cast("array<double>"))


def mean_of(vectors: Column) -> Column:
    """The mean of an array of vectors of one dimension, at length one."""
    first = F.transform(F.element_at(vectors, 1).cast("array<double>"), lambda _: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda s, v: F.zip_with(s, v.cast("array<double>"), lambda x, y: x + y))
    return unit(F.transform(total, lambda x: x / F.size(vectors)))


def fake_embedding(seed: Column, dim: int) -> Column:
    """A unit vector that a text determines, as a stand-in for a model: component i comes from 52 bits of sha256 of ``i:text``."""
    def component(i: Column) -> Column:
        digits = F.substring(F.sha2(F.concat_ws(":", i.cast("string"), seed), 256), 1, 13)
        return F.conv(digits, 16, 10).cast("double") / 2.0**51 - 1

    return F.when(seed.isNotNull(), unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component)))


def mean_vectors(rows: DataFrame, by: Sequence[str], vec: str = "vec") -> DataFrame:
    """``(by, vec)``: the mean of each group's vectors, at length one. Sums are partial, so a group of any size is a row of sums."""
    each = rows.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    means = each.groupBy(*by, "i").agg(F.avg("x").alias("x")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    return means.select(*by, unit(F.col("m.x")).alias(vec))


def to_literal(vec: Column) -> Column:
    """``[0.1,0.2]``: the text form of a vector."""
    return F.concat(F.lit("["), F.array_join(F.transform(vec.cast("array<double>"), lambda x: x.cast("string")), ","), F.lit("]"))


def from_literal(text: Column) -> Column:
    """The vector of a text form; null for anything else."""
    shaped = text.rlike(r"^\s*\[[^\[\]]*\]\s*$")
    parts = F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",")
    values = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(shaped & F.forall(values, lambda x: x.isNotNull()), values)
