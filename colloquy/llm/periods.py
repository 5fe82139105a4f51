"""Runs of repeated words: stretches of a text that repeat with some period.

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)``
words long, that no neighbouring word extends. A lag of q words can hold one
only if at least ``max(6 - q, 3 q)`` words equal those q further on. So matches
are counted for every lag first: for words that are frequent in their text by an
exact autocorrelation (FFT of their places, counts rounded to whole numbers), for
all others by the differences of their places. Only lags with enough matches are
scanned for islands of adjacent matches. Lags are taken in ascending order; a run
that is found has all the matches that it makes at multiples of its period taken
off their counts, as such a stretch has a smaller period than those: a text of
one word repeated is scanned once, not at every lag.

Defined cases: a null, empty or wordless text has no words and no runs; runs that
overlap are all told; repeated rows have equal results; texts of any length are
read whole, and one beyond a batch is a batch of its own; columns other than
those named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import pieces
from colloquy.llm.common import Batches, arrow_map, ship_package, text_groups

SPACE = r"[\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LEAST, TIMES = 6, 4
#: Text bytes that are worked on together.
TOGETHER = 2 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and where each text's words begin, with the end of the last."""
    data, bounds = pieces.raw(texts)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = bounds[:-1][np.diff(bounds) > 0]
    first[filled] = inside[filled]
    ends = bounds[1:][np.diff(bounds) > 0] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    edges = np.empty(2 * len(starts) + 1, dtype=np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, stops, stops[-1] if len(stops) else 0
    between = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return between.take(pa.array(np.arange(0, 2 * len(starts), 2))), np.searchsorted(starts, bounds)


def needed(lags: np.ndarray) -> np.ndarray:
    """Matches that a run of each lag has at least."""
    return np.maximum(LEAST, TIMES * lags) - lags


def lag_counts(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words equal the word q further on in their text, for each text and lag q up to a quarter of its words.

    The counts of text d begin at ``base[d]``, that of lag 0 being 0. A word is
    frequent in a text of n words beyond ``max(64, sqrt(n log n))`` places.
    """
    n = np.diff(begins)
    most = n // TIMES
    base = np.concatenate([[0], np.cumsum(most + 1)])
    counts = np.zeros(int(base[-1]), dtype=np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, owner))  # stable: places stay in order
    w, d = words[order], owner[order]
    fresh = np.ones(len(w), dtype=bool)
    fresh[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    group = np.flatnonzero(fresh)
    size = np.diff(np.concatenate([group, [len(w)]]))
    limit = np.maximum(64, np.sqrt(n * np.log2(np.maximum(n, 2)))).astype(np.int64)
    heavy = size > limit[d[group]] if len(group) else np.zeros(0, dtype=bool)

    for doc in np.unique(d[group[heavy]]).tolist():
        reach = int(most[doc])
        length = 1 << int(n[doc] + reach).bit_length()
        power = np.zeros(length // 2 + 1)
        for g in np.flatnonzero(heavy & (d[group] == doc)).tolist():
            marks = np.zeros(length)
            marks[order[group[g] : group[g] + size[g]] - begins[doc]] = 1.0
            spectrum = np.fft.rfft(marks)
            power += spectrum.real**2 + spectrum.imag**2
        found = np.rint(np.fft.irfft(power, length)[1 : reach + 1]).astype(np.int64)
        counts[base[doc] + 1 : base[doc] + 1 + reach] += found

    # Places of rare words: the k-th next place of the same word, while any is near enough.
    end = np.repeat(group + size, size)
    at = np.flatnonzero(np.repeat(~heavy, size))
    k = 1
    while len(at):
        at = at[at + k < end[at]]
        lag = order[at + k] - order[at]
        near = lag <= most[d[at]]
        at, lag = at[near], lag[near]
        np.add.at(counts, base[d[at]] + lag, 1)
        k += 1
    return counts, base


def islands(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches that have period ``lag`` and are long enough."""
    same = np.concatenate([[False], words[:-lag] == words[lag:], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    starts, matches = edge[0::2], edge[1::2] - edge[0::2]
    good = matches >= needed(np.array([lag]))[0]
    return starts[good], matches[good] + lag


def runs_of(words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of one text, by start and period; ``counts[q]`` are the matches of lag q."""
    left = counts.copy()
    found: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero(left[1:] >= needed(np.arange(1, len(left)))).tolist():
        lag += 1
        if left[lag] < needed(np.array([lag]))[0]:
            continue
        for start, length in zip(*(x.tolist() for x in islands(words, lag)), strict=True):
            if (start, length) in found:
                continue  # has a smaller period
            found[start, length] = lag
            multiples = np.arange(2 * lag, min(len(left), length), lag)
            left[multiples] -= length - multiples
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_of_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[list[tuple[int, int, int]]], np.ndarray]:
    """``(words, begins, runs, kept)``: words of all texts, the runs of each, and which words stay when runs are collapsed."""
    words, begins = words_of(texts)
    ids = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, np.int32)
    counts, base = lag_counts(ids, begins)
    lags = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    hopeful = np.unique(np.searchsorted(base, np.flatnonzero((lags > 0) & (counts >= needed(lags))), "right") - 1)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(begins) - 1)]
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    for doc in hopeful.tolist():
        runs[doc] = runs_of(ids[begins[doc] : begins[doc + 1]], counts[base[doc] : base[doc + 1]])
        for start, length, period in runs[doc]:
            change[begins[doc] + start + period] += 1
            change[begins[doc] + start + length] -= 1
    return words, begins, runs, np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` for every row of ``docs``.

    ``runs`` are ``(start, length, period)`` in words; ``collapsed`` has the
    words that no run holds after its first period, joined by one space.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Batches) -> Batches:
        for batch in text_groups(batches, "text", TOGETHER):
            words, begins, runs, kept = runs_of_texts(batch.column(1))
            before = np.concatenate([[0], np.cumsum(kept)])[begins]
            lists = pa.LargeListArray.from_arrays(pa.array(before, pa.int64()), words.filter(pa.array(kept)))
            told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
            joined = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(begins), pa.int64()), pa.array(told, kind), joined], ["id", "n_words", "runs", "collapsed"])

    return arrow_map(rows, run, "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a repetition in every tenth document, by a hash of its id: words from the a-th on repeat the p words from there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # Not an array function for each word: the words before a, and p of them as often as it takes.
    tail = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def longest(runs: str = "runs") -> Column:
    """The run of greatest length; of equal ones the first, and of those the least period; null without runs."""
    best = F.array_max(F.expr(f"transform({runs}, r -> struct(r.length AS length, -r.start AS start, -r.period AS period))"))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))


def runs_digest(runs: str = "runs") -> Column:
    return F.sha2(F.array_join(F.expr(f"transform({runs}, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), ""), 256)
