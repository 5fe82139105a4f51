"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import session
from colloquy.session import drop_path, read_table, shared_dir, shared_path

__all__ = ["drop_path", "read_table", "shared_path"]

#: Bytes of an Arrow batch that the JVM sends to a Python worker, but for a row that is larger by itself.
BATCH_BYTES = 4 << 20
BATCH_SETTING, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
Batches = Iterator[pa.RecordBatch]
#: What a Python worker keeps between tasks, of one operator at a time.
_kept: dict[str, Any] = {}


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on executors, and bound the batches that are sent to them, unless the session has a bound of its own."""
    session.ship_package(spark)
    if spark.conf.get(BATCH_SETTING, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def kept(owner: str, make: Callable[[], Any]) -> Any:
    """What ``owner`` keeps in this worker; that of another operator is let go, as workers outlive stages."""
    if owner not in _kept:
        _kept.clear()
        give_back()
        _kept[owner] = make()
        give_back()
    return _kept[owner]


def give_back() -> None:
    """Return free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such function in this C library
        pass


def arrow_map(rows: DataFrame, run: Callable[[Batches], Batches], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` that gives memory back when a task ends."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(whole, schema)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_small(df: DataFrame) -> DataFrame:
    """``cut`` of rows that are few beside the texts.

    Very many small steps would make very many files, so there is one for each
    core, or for each 16 shuffle partitions where these are more.
    """
    spark = df.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions")) // 16
    return cut(df.coalesce(max(1, files, spark.sparkContext.defaultParallelism)))


def tidy(spark: SparkSession) -> None:
    """Let Spark delete what was shuffled for steps that are done: it does so when the driver has dropped its objects.

    Its scheduler holds those of the last job until there is another, so there is a small one.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


def column(name: str) -> Column:
    """The column of that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, text_col: str) -> tuple[DataFrame, T.StructType]:
    """``(row, text)``: all columns but the text in a struct, so that a text is sent to Python once; and the struct's type."""
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.struct(F.lit(0).alias("c0"))
    out = docs.select(row.alias("row"), column(text_col).cast("string").alias("text"))
    return out, out.schema["row"].dataType


def unpacked(done: DataFrame, docs: DataFrame, text_col: str, more: list[str]) -> DataFrame:
    """The columns of ``docs`` again, the text being ``done``'s, and the columns ``more``, which replace those of their names."""
    place = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c != text_col)}
    old = [F.col("text").alias(c) if c == text_col else F.col("row").getField(place[c]).alias(c) for c in docs.columns if c not in more]
    return done.select(*old, *more)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in shown}
    spare = 0x100
    for b in range(0x100):
        if b not in symbols:
            symbols[b] = chr(spare)
            spare += 1
    return [symbols[b] for b in range(0x100)]


def text_groups(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Split record batches so that ``column`` holds about ``limit`` bytes at most in each.

    A row is never split: one text beyond the limit is a batch of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
