"""Documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

Multi-index hashing of SimHash fingerprints (``simhash.close_pairs``) finds
pairs within two bits, but at a similarity of 0.8 fingerprints of 64 bits differ
in about ten, and balls of that size cannot be enumerated. So it comes first
here, together with the least hashes of each set, to unite most near copies with
few candidates; then an exact set join finds what is left, whatever the bits.

The exact join: the shingles of a text are put in one order, rare ones first,
and of n only the first n - ceil(0.8 n) + 1 are looked up; two sets that are
similar enough share one of these, whatever the order. The order comes from a
sample and so bears on speed only. Equal sets are one class. Of a looked-up
shingle only the components that hold it count: shingles of a single component
are dropped after a partial aggregation, and of the rest first one member for
each component is tried, then all pairs whose ends are still apart. Where more
than ``FULL`` texts share a shingle no pairs are made: the texts that such
shingles connect are compared in blocks of bounded size, which return links
enough to unite what is similar.

All links are verified by the similarity of the whole sets, so that components
are those of all similar pairs, and of no others.

Defined cases: words are what ASCII white space parts, ASCII capitals count as
small; a text of fewer than five words is one shingle; texts that are null or
without words are equal; rows without an id are left out; rows of one id are one
document; a text of any length is read whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import simhash
from colloquy.llm.common import arrow_map, cut, cut_small, ship_package, text_groups, tidy
from colloquy.llm.components import connected_components

WIDTH, SEED = 5, 42
#: Share of the texts that the order is learned from, the least number of them, and slots for what is common among them.
SHARE, SAMPLE, SLOTS = 1 / 16, 4_000, 1 << 22
#: Least hashes of a set by which near copies are first looked for.
LEAST = 4
#: Ids or shingles that are sent to every task (8 MB); more are joined by a shuffle.
SENT = 1 << 20
#: Texts that may share a shingle before they are compared in blocks; texts, and shingles, that meet in a block; columns compared at once.
FULL, BLOCK, BLOCK_SHINGLES, COLUMNS = 128, 2048, 1 << 20, 4096
#: Short hashes more or less that would have to collide for another result; so many never do.
SPARE = 4


def shingle_set(text: str | bytes | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's word shingles, each once, sorted."""
    from xxhash import xxh64_intdigest as hashed

    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text or b"")).lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([hashed(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    del words
    first, last = starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(first)))


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets have in common."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def similar(n: int, m: int, met: int) -> bool:
    """Whether sets of n and m members, ``met`` of them common, have a Jaccard similarity of 0.8 or more."""
    return 5 * met >= 4 * (n + m - met)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")


def _sets(rows: DataFrame, short: bool) -> DataFrame:
    """``(id, n, hashes)``: the set of each row as bytes, of 32 bits each if ``short``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text", 4 << 20):
            sets = [shingle_set(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            packed = [(np.unique((x >> np.uint64(32)).astype(np.uint32)) if short else x).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(packed, pa.binary())], ["id", "n", "hashes"])

    return arrow_map(rows, run, "id long, n long, hashes binary")


def frequency_levels(rows: DataFrame) -> np.ndarray:
    """How common shingles are, as levels from 0 (seen once or never in a sample) by the lowest bits of their hashes.

    The sample is a fixed share of all texts, so that what it does not know as
    common few texts have, however many there are. Shingles of one slot share
    the greater level; that bears on the order only, which is the same for all.
    """
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, max(SHARE, SAMPLE / max(n, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text", 4 << 20):
            sets = [shingle_set(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
            found, times = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["h", "n"])

    counted = arrow_map(part, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    slots = counted.groupBy(F.expr(f"cast(h & {SLOTS - 1} as int)").alias("slot")).agg(F.max(F.floor(F.log2("n"))).cast("byte").alias("level"))
    found = slots.toArrow()  # SLOTS rows at most
    levels = np.zeros(SLOTS, dtype=np.uint8)
    levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return levels


def _prints(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """``(id, digest, n, fp, least, prefix)``: the digest stands for the set of n shingles."""
    from xxhash import xxh128_digest

    shared_levels = rows.sparkSession.sparkContext.broadcast(levels)  # SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text", 4 << 20):
            digests, sizes, bits, least, prefixes = [], [], [], [], []
            for t in batch.column(1).cast(pa.large_binary()):
                own = shingle_set(t.as_py())
                digests.append(xxh128_digest(own.tobytes()))
                sizes.append(len(own))
                bits.append(simhash.majority(own))
                least.append(own[:LEAST].view(np.int64))
                own = own[np.argsort(shared_levels.value[(own & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")]
                prefixes.append(own[: prefix_size(len(own))].view(np.int64))
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(bits, np.uint64).view(np.int64)), pa.array(least, numbers), pa.array(prefixes, numbers)],
                ["id", "digest", "n", "fp", "least", "prefix"],
            )

    return arrow_map(rows, run, "id long, digest binary, n long, fp long, least array<long>, prefix array<long>")


def _sizes_fit(n: str, m: str) -> Column:
    return F.expr(f"5 * least({n}, {m}) >= 4 * greatest({n}, {m})")


def _places_fit(n: str, at: str, m: str, other_at: str) -> Column:
    """Whether sets of n and m shingles can be similar if these are the places of their first common one."""
    return _sizes_fit(n, m) & F.expr(f"9 * least({n} - {at}, {m} - {other_at}) >= 4 * ({n} + {m})")


def _matched(wanted: DataFrame, few: bool, source: DataFrame, key: str) -> DataFrame:
    """The rows of ``source`` whose key is wanted; a set of bounded size is sent to every task."""
    return source.join(F.broadcast(wanted) if few else wanted, key, "left_semi")


def _verified(pairs: DataFrame, rows: DataFrame, repeated: bool) -> DataFrame:
    """Those of the pairs ``(u, v)`` of ids whose sets are similar.

    Hashes of 32 bits are compared first; where a few that collide could change
    the result, hashes of 64 bits are. ``repeated``: an id may have several rows.
    """

    def compared(wanted: DataFrame, short: bool) -> DataFrame:
        ends = wanted.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        sets = _sets(_matched(ends, 2 * wanted.count() <= SENT, rows, "id"), short)
        sets = sets.distinct() if repeated else sets
        kind = np.uint32 if short else np.uint64
        a, b = (sets.select(F.col("id").alias(end), F.struct("n", "hashes").alias(name)) for end, name in (("u", "a"), ("v", "b")))
        both = wanted.join(b, "v").join(a, "u").select("u", "v", "a.n", "a.hashes", F.col("b.n").alias("m"), F.col("b.hashes").alias("others"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = []
                for n, x, m, y in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
                    n, m = n.as_py(), m.as_py()
                    met = shared(np.frombuffer(x.as_py(), kind), np.frombuffer(y.as_py(), kind))
                    far = SPARE + (n + m) ** 2 // 2**29 if short else 0
                    told.append(similar(n, m, met + far) + similar(n, m, met - far) if n or m else 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.int32())], ["u", "v", "told"])

        return cut_small(arrow_map(both, run, "u long, v long, told int").where("told > 0"))

    first = compared(pairs, True)
    doubtful = first.where("told = 1").select("u", "v")
    sure = first.where("told = 2").select("u", "v")
    return sure if doubtful.isEmpty() else sure.unionByName(compared(doubtful, False).where("told = 2").select("u", "v"))


def _ordered(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _first_candidates(small: DataFrame) -> DataFrame:
    """``(u, v)``: pairs of ``(rep, n, fp, least)`` that are close in bits or share a least hash."""
    # The first of equal fingerprints comes from a partial aggregation and is joined back, like the leaders below: no window over a value that very many share.
    firsts = small.groupBy("fp").agg(F.min("rep").alias("o"))
    equal = small.join(firsts, "fp").where("rep <> o").select(F.col("o").alias("u"), F.col("rep").alias("v"))
    close = simhash.close_pairs(small.groupBy("fp").agg(F.min("rep").alias("rep")))
    keys = small.select("rep", "n", F.explode("least").alias("key"))
    # A key's leader comes from a partial aggregation and is joined back, so that a key of very many texts needs no task of its own.
    leaders = keys.groupBy("key").agg(F.min_by(F.struct("rep", "n"), F.xxhash64("rep", "key")).alias("o"), F.count("*").alias("m")).where("m > 1")
    tried = keys.join(leaders, "key").where(_sizes_fit("n", "o.n")).select(F.col("o.rep").alias("u"), F.col("rep").alias("v"))
    every = equal.unionByName(close).unionByName(tried).select(*_ordered("u", "v")).where("u <> v")
    return every.distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, component)`` for every row with an id; component is the least id reachable over similar texts."""
    ship_package(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    prints = cut(_prints(rows, frequency_levels(rows)))
    repeated = not prints.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1").isEmpty()
    classes = cut_small(prints.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("least").alias("least")))
    links = united = None

    def unite(pairs: DataFrame) -> None:
        """Try the pairs, and take those that are similar into the components."""
        nonlocal links, united
        if links is not None and pairs.isEmpty():
            return
        found = _verified(pairs, rows, repeated)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            united = connected_components(links)
        tidy(rows.sparkSession)

    candidates = cut_small(_first_candidates(classes.select("rep", "n", "fp", "least").distinct()))
    unite(candidates)

    placed = cut(_placed(prints, classes, united))
    lookups = placed.select("rep", "c", "n", F.posexplode("prefix").alias("at", "token"))
    several = cut_small(lookups.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token"))
    mixed = cut_small(_matched(several, several.count() <= SENT, lookups, "token"))
    # One member of each component that has the shingle, against that of one component.
    one = mixed.groupBy("token", "c").agg(F.min_by(F.struct("rep", "n", "at"), F.xxhash64("rep", "token")).alias("me"))
    heads = one.groupBy("token").agg(F.min_by("me", F.xxhash64("c", "token")).alias("o"))
    next_to = one.join(heads, "token").where("me.rep <> o.rep").where(_places_fit("me.n", "me.at", "o.n", "o.at"))
    tried = cut_small(next_to.select(*_ordered("me.rep", "o.rep")).distinct().join(candidates, ["u", "v"], "left_anti"))
    unite(tried)

    # The pair's first common shingle passes the test, so every similar pair is met in one bucket at least.
    now = _united(mixed.drop("c"), united)
    tidy(rows.sparkSession)
    sizes = now.groupBy("token").agg(F.count("*").alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token", "k")
    now = cut_small(now.join(sizes, "token"))
    a, b = (now.where(f"k <= {FULL}").select("token", *(F.col(x).alias(x + s) for x in ("rep", "n", "at", "c"))) for s in "12")
    left = a.join(b, "token").where("c1 < c2").where(_places_fit("n1", "at1", "n2", "at2"))
    left = left.select(*_ordered("rep1", "rep2")).distinct().join(tried.unionByName(candidates), ["u", "v"], "left_anti")
    unite(cut_small(left))
    crowd = now.where(f"k > {FULL}")
    if not crowd.isEmpty():
        links = links.unionByName(_links_of_crowds(crowd.drop("c"), united, rows, repeated))
        united = connected_components(links)
    resolved = _united(classes.select("digest", "rep"), united).select("digest", F.col("c").alias("component"))
    return prints.select("id", "digest").join(resolved, "digest").select("id", "component")


def _links_of_crowds(crowd: DataFrame, united: DataFrame, rows: DataFrame, repeated: bool) -> DataFrame:
    """Links that unite what is similar among the texts of buckets that are too full to make their pairs.

    Texts that share such buckets are a family. A family is dealt into parts,
    every two of which meet in a block, where all their sets are compared at
    once; a block returns a link for each text that it unites with another.
    """
    crowd = _united(crowd, united)
    leaders = crowd.groupBy("token").agg(F.min("rep").alias("leader"))
    family = connected_components(crowd.join(leaders, "token").select(F.col("rep").alias("u"), F.col("leader").alias("v")))
    members = crowd.select("rep", "c", "n").distinct().join(family.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
    spans = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    parts = F.greatest(F.ceil(F.col("m") / (BLOCK // 2)), F.ceil(F.col("shingles") / (BLOCK_SHINGLES // 2))).cast("int")
    dealt = members.join(spans.select("family", parts.alias("parts")), "family").withColumn("part", F.expr("pmod(xxhash64(rep), parts)"))
    dealt = cut_small(dealt.select(F.col("rep").alias("id"), "c", "family", "part", "parts"))
    sets = _sets(_matched(dealt.select("id").distinct(), dealt.count() <= SENT, rows, "id"), False)
    sets = sets.distinct() if repeated else sets
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = dealt.join(sets, "id").select("id", "c", "n", "hashes", "family", "part", other)
    met = met.select("id", "c", "n", "hashes", "part", "family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ids, comps, n, part = (table.column(c).to_numpy() for c in ("id", "c", "n", "part"))
        apart = comps[:, None] != comps[None, :]
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            apart &= part[:, None] != part[None, :]
        near = similar_pairs([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()], n) & apart
        label = least_labels(near)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[label[moved]], pa.int64()), "v": pa.array(ids[moved], pa.int64())})

    return cut_small(met.groupBy("family", "i", "j").applyInArrow(compare, "u long, v long").select(*_ordered("u", "v")))


def similar_pairs(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Which of some sets are similar, as a square of truth values."""
    met = np.zeros((len(sets), len(sets)), dtype=np.float32)
    names, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = np.cumsum(times > 1) - 1
    held = times[where] > 1
    owner, where = owner[held], place[where[held]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        first, last = np.searchsorted(where, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[owner[first:last], where[first:last] - at] = 1
        met += has @ has.T
    total = (n[:, None] + n[None, :]).astype(np.float64)
    return 5 * met >= 4 * (total - met)


def least_labels(near: np.ndarray) -> np.ndarray:
    """The least index that each can reach over a symmetric square of truth values."""
    label = np.arange(len(near))
    a, b = np.nonzero(near)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def _united(rows: DataFrame, united: DataFrame) -> DataFrame:
    """Rows with the component ``c`` of their ``rep``."""
    return rows.join(united.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))


def _placed(prints: DataFrame, classes: DataFrame, united: DataFrame) -> DataFrame:
    """``(rep, c, n, prefix)``: one row for each class; by id and digest, so that many copies of one text meet in no task."""
    named = _united(classes.select("digest", "rep"), united).select(F.col("rep").alias("id"), "digest", "c")
    return prints.select("id", "digest", "n", "prefix").join(named, ["id", "digest"]).select(F.col("id").alias("rep"), "c", "n", "prefix")
