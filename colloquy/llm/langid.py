"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its
letters' vectors, each permuted (rotated) by its place; a text is the bundle
(sum) of its trigrams' vectors; a language's prototype bundles the texts that
carry its label, each with the same weight. A text goes to the language whose
prototype has the greatest cosine with it.

Trigrams run over letters in lower case; whatever lies between words is one
boundary symbol, also before the first and after the last word. All rows that
may be learned from are learned from: each task bundles its rows by language,
and only sums of ``DIMENSIONS`` numbers a language are gathered.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
and so is every text if nothing could be learned; equal cosines go to the
language that sorts first; a row without a label teaches nothing; repeated rows
count as often as they occur; an empty table gives an empty result. A text is
read whole however long it is: a task holds some numbers for each of its
letters, and batches of texts are bounded by ``TEXT_AT_ONCE``. Further columns
of any name are kept; ``lang_pred`` and ``lang_score`` replace columns of those
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import arrow_map, held_out, kept, packed, ship_package, text_groups, unpacked

DIMENSIONS = 1024
SEED = 20260
TEXT_AT_ONCE = 2 << 20
#: Texts that are compared at once, and letters whose vectors a worker remembers.
BLOCK, REMEMBERED = 64, 20_000
CODES = 0x110000
UNKNOWN = "und"


class Letters:
    """Which code points are letters, and their vectors."""

    def __init__(self) -> None:
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(CODES)), dtype=bool, count=CODES)
        self.place = np.zeros(CODES + 1, dtype=np.int32)
        self.vectors: dict[int, np.ndarray] = {}

    def vector(self, symbol: int) -> np.ndarray:
        """The random vector of a symbol: a letter's code point and one; 0 is the boundary."""
        if symbol not in self.vectors:
            if len(self.vectors) >= REMEMBERED:
                self.vectors.clear()
            self.vectors[symbol] = np.random.default_rng([SEED, symbol]).choice(np.array([-1, 1], dtype=np.int8), DIMENSIONS)
        return self.vectors[symbol]


def _letters() -> Letters:
    return kept("letters", Letters)


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text's letters, with one 0 between words and at both ends; empty if there is no letter."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(len(codes) + 2, dtype=np.int32)
    out[1:-1] = np.where(_letters().is_letter[codes], codes + 1, 0)
    keep = out != 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    out = out[keep]
    if out[-1] != 0:
        out = np.append(out, 0)
    return out if len(out) > 2 else np.zeros(0, dtype=np.int32)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(columns, bounds, vectors)``: the texts' trigrams in a row, where each text's begin and end, and the vector of each distinct one."""
    rows = [symbols(t) for t in texts]
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(lengths - 2, 0))])
    if not bounds[-1]:
        return np.zeros(0, np.int32), bounds, np.zeros((0, DIMENSIONS), np.int8)
    joined = np.concatenate(rows)
    place = _letters().place
    place[joined] = 1
    present = np.flatnonzero(place)
    k = len(present)
    place[present] = np.arange(k)
    small = place[joined].astype(np.int64 if k > 1200 else np.int32)
    place[present] = 0
    grams = (small[:-2] * k + small[1:-1]) * k + small[2:]
    ends = np.cumsum(lengths)[lengths > 0]
    inside = np.ones(len(joined), dtype=bool)
    inside[ends - 1] = inside[ends - 2] = False
    grams = grams[inside[:-2]]
    if k**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(grams, minlength=k**3))
        dense = np.zeros(k**3, dtype=np.int32)
        dense[seen] = np.arange(len(seen))
        columns = dense[grams]
    else:
        seen, columns = np.unique(grams, return_inverse=True)
    letters = np.stack([_letters().vector(int(s)) for s in present])
    vectors = np.roll(letters, 2, axis=1)[seen // (k * k)]
    vectors *= np.roll(letters, 1, axis=1)[seen // k % k]
    vectors *= letters[seen % k]
    return columns, bounds, vectors


def bundles(columns: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The sum of each text's vectors: of a block of texts at a time, over the trigrams that the block has."""
    out = np.zeros((len(bounds) - 1, DIMENSIONS), dtype=np.float32)
    place = np.zeros(len(vectors), dtype=np.int32)
    for a in range(0, len(out), BLOCK):
        b = min(len(out), a + BLOCK)
        own = columns[bounds[a] : bounds[b]]
        if not len(own):
            continue
        seen = np.flatnonzero(np.bincount(own, minlength=len(vectors)))
        place[seen] = np.arange(len(seen))
        text = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        counts = np.bincount(text * len(seen) + place[own], minlength=(b - a) * len(seen)).reshape(b - a, len(seen))
        out[a:b] = counts.astype(np.float32) @ vectors[seen].astype(np.float32)
    return out


def learn(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """``(languages, prototypes)`` from the rows of ``docs`` for which ``usable`` holds and the label is not null."""
    ship_package(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_groups(batches, "text", TEXT_AT_ONCE):
            columns, bounds, vectors = trigrams(batch.column(0).to_pylist())
            own: dict[str, np.ndarray] = {}
            for lang, a, b in zip(batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b > a:
                    own[lang] = own.get(lang, 0.0) + np.bincount(columns[a:b], minlength=len(vectors)) / (b - a)
            for lang, weights in own.items():
                for at in range(0, len(vectors), 2048):
                    sums[lang] = sums.get(lang, 0.0) + weights[at : at + 2048] @ vectors[at : at + 2048].astype(np.float64)
        if sums:
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(sums), DIMENSIONS), pa.string()), pa.array(np.tile(np.arange(DIMENSIONS), n), pa.int32()), pa.array(np.concatenate(list(sums.values())), pa.float64())],
                ["lang", "place", "value"],
            )

    parts = arrow_map(rows, run, "lang string, place int, value double")
    found = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", "v.value").collect()
    table = {r["lang"]: np.array(r["value"], dtype=np.float64) for r in found}
    names = sorted(n for n, v in table.items() if np.linalg.norm(v) > 0)
    if not names:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    return names, np.stack([table[n] / np.linalg.norm(table[n]) for n in names]).astype(np.float32)


def predict(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and cosine (from 0 to 1) of each text."""
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    columns, bounds, vectors = trigrams(texts)
    profiles = bundles(columns, bounds, vectors)
    norms = np.linalg.norm(profiles, axis=1)
    cosines = (profiles @ prototypes.T) / np.maximum(norms, 1e-12)[:, None]
    best = cosines.argmax(axis=1)
    score = np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0).astype(np.float64)
    some = bounds[1:] > bounds[:-1]
    score[~some] = 0.0
    return [names[b] if n else UNKNOWN for b, n in zip(best.tolist(), some.tolist(), strict=True)], score


def _predicted(rows: DataFrame, names: list[str], prototypes: np.ndarray, with_text: bool) -> DataFrame:
    """``(row, lang_pred, lang_score)`` of rows ``(row, text)``, and the text if it is wanted."""
    out = ["row", *(["text"] if with_text else []), "lang_pred", "lang_score"]
    schema = T.StructType([*(rows.schema[c] for c in out[:-2]), T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text", TEXT_AT_ONCE):
            langs, scores = predict(batch.column(1).to_pylist(), names, prototypes)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out) - 2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], out)

    return arrow_map(rows, run, schema)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``lang_score``, which replace columns of those names."""
    ship_package(docs.sparkSession)
    rows, _ = packed(docs, text_col)
    return unpacked(_predicted(rows, names, prototypes, True), docs, text_col, ["lang_pred", "lang_score"])


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, held_out, lang_pred, lang_score)``, learned from the rows that are not held out."""
    names, prototypes = learn(docs, ~held_out(F.col(id_col)), text_col, lang_col)
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).cast("string").alias("text"))
    done = _predicted(rows, names, prototypes, False).select("row.id", "lang_pred", "lang_score")
    return done.select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "lang_score")
