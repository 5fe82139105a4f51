"""Benchmark decontamination by winnowing.

Test items and documents are cut into words; every k-gram of words has a hash;
of each sliding window of w k-grams the least hash is kept as a fingerprint.
Two texts that share k + w - 1 words in a row share a fingerprint, so with
k = 5 and w = 6 no shared span of ten words goes unseen. Matching fingerprints
are extended word by word, and only spans of at least ten equal words count:
hash collisions are thereby ruled out. Items of fewer than ten words are found
by a hash of all their words at every position, and verified likewise.

Test items are held in blocks of at most ``BLOCK_BYTES``; a larger benchmark is
worked off block by block, and the hits of the blocks are united. Documents are
never shuffled while the benchmark fits one block.

Defined cases: a null or wordless document has no words and no hits; a null or
wordless item, or one without an id, has no windows; repeated items with one id
count once; repeated documents give repeated rows; of equal least hashes in a
window all are kept; a text of any length is read whole, in pieces; columns other
than those named are not read, or kept as they are by ``without_hits``; empty
tables give an empty result, or no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import arrow_map, cut, packed, ship_package, text_groups, unpacked

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Text bytes of the test items that one pass holds in memory.
BLOCK_BYTES = 16 << 20
#: Text bytes that are turned into words at once, and words matched at once.
PIECE = 1 << 20
WORDS_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 1 << 17
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_ids(text: str | bytes | None, known: dict[bytes, int], grow: bool = False) -> np.ndarray:
    """Numbers of a text's words; words that ``known`` lacks are 0, or are added."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    data = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)).lower()
    parts, at = [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            gap = GAP.search(data, end)
            end = gap.start() if gap else len(data)
        words = WORD.findall(data, at, end)
        if grow:
            for w in words:
                known.setdefault(w, len(known) + 1)
        parts.append(np.fromiter((known.get(w, 0) for w in words), dtype=np.int32, count=len(words)))
        at = end
    return np.concatenate(parts)


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k words in a row."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = ids.astype(np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ wide[j : j + n]) * MIX
            out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is least in some window of ``w``; fewer hashes are one window."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    w = min(w, len(hashes))
    n = len(hashes) - w + 1
    least = hashes[:n].copy()
    for j in range(1, w):
        np.minimum(least, hashes[j : j + n], out=least)
    best = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(w):
        np.maximum(best[j : j + n], least, out=best[j : j + n])
    return np.flatnonzero(best == hashes)


class Index:
    """Fingerprints of one block of test items."""

    def __init__(self, items: list[tuple[str, str]], span: int = 10, k: int = 5):
        self.span, self.k, self.w = span, k, span - k + 1
        self.known: dict[bytes, int] = {}
        by_words: dict[bytes, set[str]] = defaultdict(set)
        for item_id, text in items:
            ids = word_ids(text, self.known, grow=True)
            if item_id is not None and len(ids):
                by_words[ids.tobytes()].add(item_id)
        words = sorted(by_words)
        texts = [np.frombuffer(x, dtype=np.int32) for x in words]
        self.names = [sorted(by_words[x]) for x in words]
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ids = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int32)
        self.table = self._table([i for i, x in enumerate(texts) if len(x) >= span], k, True)
        short = defaultdict(list)
        for i, x in enumerate(texts):
            if len(x) < span:
                short[len(x)].append(i)
        self.short = {n: self._table(v, n, False) for n, v in sorted(short.items())}

    def _table(self, items: list[int], k: int, sparse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in ascending order, and the position and item of each."""
        hashes, places, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in items:
            h = gram_hashes(self.ids[self.starts[i] : self.starts[i + 1]], k)
            at = winnow(h, self.w) if sparse else np.arange(len(h))
            hashes.append(h[at])
            places.append(at + self.starts[i])
            owners.append(np.full(len(at), i, dtype=np.int64))
        h, p, o = map(np.concatenate, (hashes, places, owners))
        order = np.argsort(h, kind="stable")
        return h[order], p[order], o[order]

    @staticmethod
    def _meet(found: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position, item position and item of equal hashes, some at a time."""
        hashes, places, owners = table
        if not len(hashes) or not len(found):
            return
        low = np.searchsorted(hashes, found, "left")
        hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == found)
        low, at = low[hit], at[hit]
        many = np.searchsorted(hashes, found[hit], "right") - low
        begin = 0
        total = np.cumsum(many)
        while begin < len(many):
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, "right")))
            reps = many[begin:end]
            where = np.repeat(low[begin:end], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            yield np.repeat(at[begin:end], reps), places[where], owners[where]
            begin = end

    def match(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(hit, position, item)``: which words are hit, and where which item was met.

        ``ids`` may hold several documents with a 0 between them: no span reaches over it.
        """
        n = len(ids)
        edge = np.zeros(n + 1, dtype=np.int64)
        spots, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        hashes = gram_hashes(ids, self.k)
        at = winnow(hashes, self.w)
        reach = self.span - self.k
        for p, q, item in self._meet(hashes[at], at, self.table):
            first, last = self.starts[item], self.starts[item + 1]
            good = np.ones(len(p), dtype=bool)
            for j in range(self.k):
                good &= ids[p + j] == self.ids[q + j]
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            going = good.copy()
            for j in range(1, reach + 1):
                a, b = p - j, q - j
                going &= (a >= 0) & (b >= first)
                going &= ids[np.maximum(a, 0)] == self.ids[np.maximum(b, 0)]
                left += going
            going = good.copy()
            for j in range(self.k, self.span):
                a, b = p + j, q + j
                going &= (a < n) & (b < last)
                going &= ids[np.minimum(a, n - 1)] == self.ids[np.minimum(b, len(self.ids) - 1)]
                right += going
            good &= left + right + self.k >= self.span
            np.add.at(edge, (p - left)[good], 1)
            np.add.at(edge, (p + self.k + right)[good], -1)
            spots.append(p[good])
            items.append(item[good])
        for size, table in self.short.items():
            hashes = gram_hashes(ids, size)
            for p, q, item in self._meet(hashes, np.arange(len(hashes)), table):
                good = np.ones(len(p), dtype=bool)
                for j in range(size):
                    good &= ids[p + j] == self.ids[q + j]
                np.add.at(edge, p[good], 1)
                np.add.at(edge, p[good] + size, -1)
                spots.append(p[good])
                items.append(item[good])
        return np.cumsum(edge[:n]) > 0, np.concatenate(spots), np.concatenate(items)

    def documents(self, texts: list) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: its number of words, the spans of hit words, and the items met."""
        out: list = [None] * len(texts)
        held: list[tuple[int, np.ndarray]] = []
        total = 0

        def flush() -> None:
            nonlocal held, total
            if not held:
                return
            gap = np.zeros(1, dtype=np.int32)
            ids = np.concatenate([y for _, x in held for y in (x, gap)])
            starts = np.cumsum([0] + [len(x) + 1 for _, x in held])
            met: dict[int, set[int]] = defaultdict(set)
            hit = np.zeros(len(ids), dtype=bool)
            for a in range(0, max(1, len(ids)), WORDS_AT_ONCE):
                lo, hi = max(0, a - self.span), min(len(ids), a + WORDS_AT_ONCE + self.span)
                h, spot, item = self.match(ids[lo:hi])
                hit[lo:hi] |= h
                if len(spot):
                    doc = np.searchsorted(starts, spot + lo, "right") - 1
                    pairs = np.unique(doc * len(self.names) + item)
                    for d, i in zip((pairs // len(self.names)).tolist(), (pairs % len(self.names)).tolist(), strict=True):
                        met[d].add(i)
            change = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            spans = change.reshape(-1, 2)
            owner = np.searchsorted(starts, spans[:, 0], "right") - 1
            own: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for d, (a, b) in zip(owner.tolist(), spans.tolist(), strict=True):
                own[d].append((a - int(starts[d]), b - int(starts[d])))
            for d, (i, x) in enumerate(held):
                names = sorted({n for m in met.get(d, ()) for n in self.names[m]})
                out[i] = (len(x), own.get(d, []), names)
            held, total = [], 0

        for i, t in enumerate(texts):
            x = word_ids(t, self.known)
            held.append((i, x))
            total += len(x)
            if total >= WORDS_AT_ONCE:
                flush()
        flush()
        return out


def _blocks(items: DataFrame, limit: int) -> list[Callable[[], list[tuple[str, str]]]]:
    """The test items in blocks of about ``limit`` bytes; every row goes by its own hash."""
    size = items.agg(F.sum(F.octet_length("text") + 32).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // limit))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [lambda b=b: [(r[0], r[1]) for r in items.where(slot == b).select("item_id", "text").toLocalIterator()] for b in range(blocks)]


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    return items.where("item_id is not null and text is not null").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, n_words, spans, items)`` for every document row.

    ``spans`` are the half-open word ranges that test items cover, in order and
    apart from each other; ``items`` the ids (as strings, sorted) of the items
    that have a window in the document.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = _items(benchmark, item_id, item_text)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").alias("text"))
    schema = "id long, n_words long, spans array<struct<a: long, b: long>>, items array<string>"
    blocks = _blocks(items, block_bytes)

    def one(source: DataFrame, block: list[tuple[str, str]], keyed: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(block, span, k))  # bounded by block_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in text_groups(batches, "text", 4 << 20):
                found = index.documents(batch.column(1).cast(pa.large_binary()).to_pylist())
                columns = [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in x[1]] for x in found], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array([x[2] for x in found], pa.list_(pa.string())),
                ]
                names = ["id", "n_words", "spans", "items"]
                if keyed:
                    columns.append(batch.column(2))
                    names.append("row")
                yield pa.RecordBatch.from_arrays(columns, names)

        return arrow_map(source, run, schema + (", row string" if keyed else ""))

    if len(blocks) == 1:
        return one(rows, blocks[0](), False)
    # Equal rows have equal results, so a hash of the row may stand for it.
    keyed = rows.select("id", "text", F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256).alias("row"))
    parts = None
    for load in blocks:
        part = cut(one(keyed, load(), True).where("size(items) > 0").dropDuplicates(["row"]).select("row", "spans", "items"))
        parts = part if parts is None else parts.unionByName(part)
    united = parts.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<a: bigint, b: bigint>>), (acc, x) -> case when size(acc) > 0 and x.a <= element_at(acc, -1).b"
        " then concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))) else concat(acc, array(x)) end)"
    )
    empty = one(keyed, [], True).select("id", "row", "n_words")
    joined = empty.join(united.select("row", merged.alias("spans"), "items"), "row", "left")
    return joined.select("id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def without_hits(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test item has a window.

    Rows are judged where they are read and never shuffled. Of a benchmark of
    several blocks each judges what the one before has left, which is written to
    the shared folder between them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows, kind = packed(docs, doc_text)
    schema = T.StructType([T.StructField("row", kind), T.StructField("text", T.StringType())])
    blocks = _blocks(_items(benchmark, item_id, item_text), block_bytes)
    for i, load in enumerate(blocks):
        shared = spark.sparkContext.broadcast(Index(load(), span, k))  # bounded by block_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in text_groups(batches, "text", 4 << 20):
                found = index.documents(batch.column(1).cast(pa.large_binary()).to_pylist())
                yield batch.filter(pa.array([not x[1] for x in found], pa.bool_()))

        rows = arrow_map(rows, run, schema)
        if i < len(blocks) - 1:
            rows = cut(rows)
    return unpacked(rows, docs, doc_text, [])


def digest(names: str = "items"):
    """sha256 of the comma-joined names, which are sorted already."""
    return F.sha2(F.array_join(names, ","), 256)


def n_hit(spans: str = "spans"):
    return F.expr(f"aggregate({spans}, 0L, (n, x) -> n + x.b - x.a)")


