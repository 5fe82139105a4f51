"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits, and a table per segment lists
the fingerprints under the value that they have there. Two fingerprints that
differ in at most two bits differ in at most one bit of the low segment, or in
none of the high one. So the Hamming ball of radius one around the low segment
and the high segment itself (a ball of radius zero) are looked up; complete
distances of what is fetched are verified. Of two fingerprints that differ in
one bit of the low segment only the one whose bit is 0 asks for the other.

A value that more than ``FULL`` fingerprints share in a segment would make pairs
with the square of their number. Its members are split by the other segment:
those that agree in this one are looked up by a ball of radius one around the
other, in which two of distance two meet; those that ask for it are looked up
with all of their bits. Such buckets hold 33 members at most, whose links form a
chain; together the chains connect exactly what all links connect.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; repeated rows stay repeated; rows with a null id keep their fingerprint
and take the class of their fingerprint; a text of any length is read whole, in
pieces of ``SHINGLES_AT_ONCE`` hashes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, cut, cut_small, ship_package, text_groups
from colloquy.llm.components import connected_components

SEED = 42
#: Shingles hashed at a time, so that a long text needs little memory besides itself.
SHINGLES_AT_ONCE = 1 << 18


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 hashes have each bit set; position 0 is the lowest bit."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(octets) < 256:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    shifted = octets + (np.arange(8, dtype=np.int64) << 8)
    per_octet = np.bincount(shifted.ravel(), minlength=2048).reshape(8, 256)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return (per_octet @ table).ravel()


def fingerprint(text: str | bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest as hashed

    if not text:
        return 0
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return hashed(joined, SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    del words
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), SHINGLES_AT_ONCE):
        pairs = zip(first[at : at + SHINGLES_AT_ONCE].tolist(), last[at : at + SHINGLES_AT_ONCE].tolist(), strict=True)
        counts += _bit_counts(np.array([hashed(joined[a:b], SEED) for a, b in pairs], dtype=np.uint64))
    bits = counts * 2 > len(first)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes; zero of none."""
    return int(np.packbits(_bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` for every row; fp is the fingerprint's bit pattern as a long."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text", 8 << 20):
            texts = batch.column(1).cast(pa.large_binary())
            out = np.fromiter((fingerprint(t.as_py(), width) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    return arrow_map(rows, run, "id long, fp long")


#: Fingerprints that may share a segment's value before they are split by the other segment.
FULL = 32


def _low(fp: str = "fp") -> Column:
    return F.expr(f"{fp} & 4294967295")


def _entries(classes: DataFrame) -> DataFrame:
    """``(key, n, fp, rep)``: the fingerprints under the value of each segment, which n of them share.

    A key is a segment's value, with bit 32 set for that of the high segment.
    Values are counted before they are dealt out, and a value that very many
    share is joined with its one count.
    """
    entries = classes.select(F.explode(F.array(_low(), F.expr("shiftrightunsigned(fp, 32) | 4294967296"))).alias("key"), "fp", "rep")
    return entries.join(entries.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "n", "fp", "rep")


def _lookups(classes: DataFrame) -> DataFrame:
    """``(key, fp, rep)``: the ball of radius one around the low segment, of which two fingerprints meet at one of them."""
    ball = F.expr("transform(filter(sequence(0, 31), i -> (shiftright(fp, i) & 1) = 0), i -> (fp & 4294967295) | shiftleft(1L, i))")
    return classes.select(F.explode(ball).alias("key"), "fp", "rep")


def close_pairs(classes: DataFrame, max_distance: int = 2, full: int = FULL) -> DataFrame:
    """Links ``(u, v)`` between rows ``(rep, fp)`` of distinct fingerprints; what they connect is what all links connect."""
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance must be 0, 1 or 2")
    if max_distance == 0:
        return classes.select(F.col("rep").alias("u"), F.col("rep").alias("v")).where("false")
    table = cut_small(_entries(classes))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_distance
    few = table.where(f"n <= {full}").select("key", F.col("fp").alias("fp2"), F.col("rep").alias("v"))
    asked = _lookups(classes).join(few, "key").where(near)
    agree = table.where(f"n > 1 and n <= {full}").drop("n").join(few, "key").where((F.col("fp") < F.col("fp2")) & near)
    links = asked.unionByName(agree).select(F.col("rep").alias("u"), "v")
    crowded = table.where(f"n > {full}").drop("n")
    if crowded.isEmpty():
        return links
    # Ball of radius one around the segment that is not the key's.
    first = "if(key >= 4294967296, 0, 32)"
    others = F.expr(f"concat(array(fp), transform(sequence(0, 31), i -> fp ^ shiftleft(1L, i + {first})))")
    agree = crowded.select("key", "fp", "rep", F.explode(others).alias("ball"))
    if max_distance == 2:
        cell = Window.partitionBy("key", "ball").orderBy("fp")
        chain = agree.select("fp", F.col("rep").alias("u"), F.lag("fp").over(cell).alias("fp2"), F.lag("rep").over(cell).alias("v")).where("fp2 is not null")
    else:
        chain = agree.where("fp <> ball").join(classes.select(F.col("fp").alias("ball"), F.col("fp").alias("fp2"), F.col("rep").alias("v")), "ball").select("fp", F.col("rep").alias("u"), "fp2", "v")
    # A lookup has one bit of the low segment flipped already; of the high one another may differ.
    whole = F.expr("(fp & -4294967296) | key")
    flips = F.expr("concat(array(0L), transform(sequence(32, 63), i -> shiftleft(1L, i)))") if max_distance == 2 else F.array(F.lit(0).cast("long"))
    values = crowded.select("key").distinct()
    asked = _lookups(classes).join(values, "key", "left_semi").select("fp", F.col("rep").alias("u"), F.explode(F.transform(flips, lambda x: whole.bitwiseXOR(x))).alias("fp2"))
    answered = asked.join(classes.select(F.col("fp").alias("fp2"), F.col("rep").alias("v")), "fp2").select("fp", "u", "fp2", "v")
    return links.unionByName(chain.unionByName(answered).where(near).select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_distance: int = 2) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    classes = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    links = close_pairs(classes.where("rep is not null"), max_distance)
    components = connected_components(links)
    resolved = classes.join(components, classes["rep"] == components["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(resolved, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
