"""Fill-in-middle transformation of whole Arrow batches.

A batch of texts is one buffer of UTF-8 bytes. A table gives every byte's class
(line feed, sentinel sign, continuation of a character, other); a unit begins at
a document's first byte and after every line feed, which a mask over adjacent
bytes shows. Sums of that mask that begin anew with each document number the
units, and one ``searchsorted`` finds where the chosen units begin for all rows
together. Prefix, middle and suffix are then slices of the same buffer, joined
with their sentinels a column at a time.

Defined cases: a null or empty text, and one that holds a sentinel, is plain and
its output is the text; a null id is keyed as the empty string; cuts that fall
together leave an empty middle; repeated rows have equal results; a text of any
length is a batch of its own; columns other than those named are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import pieces
from colloquy.llm.common import Batches, arrow_map, ship_package, text_groups

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes.
OTHER, FEED, OPEN, LETTER, CLOSE, MORE = range(6)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[0x80:0xC0] = MORE
_CLASS[ord("\n")] = FEED
_CLASS[[ord("P"), ord("S"), ord("M")]] = LETTER
_CLASS[ord("<")], _CLASS[ord(">")] = OPEN, CLOSE


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(texts: pa.Array, h: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """``[n, form, prefix_chars, middle_chars, output]`` of a column of texts and four draws for each."""
    data, bounds = pieces.raw(texts)
    rows, size = len(bounds) - 1, len(data)
    kind = _CLASS[data]
    starts = np.zeros(size + 1, dtype=bool)
    starts[1:] = kind == FEED
    starts[bounds[:-1]] = True
    units = np.cumsum(starts[:size], dtype=np.int64 if size >= 1 << 31 else np.int32)
    # Units before each document; those of a document count from there.
    base = np.where(bounds > 0, units[np.maximum(bounds, 1) - 1], 0) if size else np.zeros(rows + 1, np.int64)
    n = np.diff(base).astype(np.int64)
    cuts = [x % (n + 1) for x in h[:2]]
    first, last = np.minimum(*cuts), np.maximum(*cuts)

    def place(cut: np.ndarray) -> np.ndarray:
        """Where unit number ``cut`` of each row begins: the first byte whose sum is beyond the units before it."""
        return np.where(cut == n, bounds[1:], np.searchsorted(units, (base[:-1] + cut + 1).astype(units.dtype), "left"))

    a, b = place(first), place(last)
    mark = np.flatnonzero((kind[:-2] == OPEN) & (kind[1:-1] == LETTER) & (kind[2:] == CLOSE)) if size > 2 else np.zeros(0, np.int64)
    owner = np.searchsorted(bounds, mark, "right") - 1
    held = np.zeros(rows, dtype=bool)
    held[owner[mark + 3 <= bounds[owner + 1]]] = True
    plain = held | (n == 0) | (h[2] % 100 >= fim_percent)
    spm = h[3] % 100 < spm_percent
    chars = np.concatenate([[0], np.cumsum(kind != MORE, dtype=units.dtype)]).astype(np.int64)
    sizes = [pa.array(chars[y] - chars[x], pa.int64(), mask=plain) for x, y in ((bounds[:-1], a), (a, b))]

    edges = np.empty(3 * rows + 1, dtype=np.int64)
    edges[0:-1:3], edges[1::3], edges[2::3], edges[-1] = bounds[:-1], a, b, size
    parts = pa.Array.from_buffers(pa.large_binary(), 3 * rows, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    prefix, middle, suffix = (parts.take(pa.array(np.arange(i, 3 * rows, 3))) for i in range(3))
    p, s, m, empty = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, empty)
    spm_form = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, empty)
    whole = pc.fill_null(texts.cast(pa.large_binary()), b"")
    output = pc.if_else(pa.array(plain), whole, pc.if_else(pa.array(spm), spm_form, psm))
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    return [pa.array(n, pa.int64()), form, *sizes, output.cast(pa.large_string())]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    ``fim_percent`` of the documents are transformed, ``spm_percent`` of those
    with the suffix first; both depend on seed and id only.
    """
    ship_package(docs.sparkSession)
    h = [x.alias(f"h{i}") for i, x in enumerate(draws(F.col(id_col), seed))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *h)

    def run(batches: Batches) -> Batches:
        for batch in text_groups(batches, "text", 4 << 20):
            drawn = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
            done = transform(batch.column(1), drawn, fim_percent, spm_percent)
            done[-1] = done[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *done], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return arrow_map(rows, run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again. A transformed text holds each sentinel once, so they cut the output into its parts."""
    part = F.split(output, "<[PSM]>", -1)
    prefix, suffix = F.when(form == "psm", part[1]).otherwise(part[2]), F.when(form == "psm", part[2]).otherwise(part[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))
