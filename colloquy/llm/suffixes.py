"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``K`` bytes that covers it also starts in a document
with a smaller id. The suffix order of a whole corpus cannot be held in one
place, but only suffixes that agree in their first K bytes matter to each other.
So suffixes are dealt out by content:

* Every string of K bytes has a hash that depends on it alone: the least hash of
  the ``M``-grams in it. Starts in a row with one least hash form a stretch.
* A first round sends the least hashes alone and tells which of them occur in
  several documents; it answers with the documents' ids and half of each hash.
  Texts meet the answers by bucket of their id, packed.
* A second round cuts the stretches with such hashes from the texts and deals
  them out by hash. There the distinct stretches of a hash are suffix-sorted (by
  the ranks of eight-byte words), suffixes that agree in K bytes being ordered
  by document. The previous smaller position of a suffix is then its neighbour
  or that one's own, the next smaller one lies beyond its equals; a suffix whose
  previous smaller position agrees with it in K bytes has a longest previous
  factor of K or more, and so the string at its start occurs in an earlier
  document.
* The starts found are united to spans, and the texts are cut.

Copies in one batch are compared there, and only those of the least id are sent.
A hash that is in very many documents is split: each of its strings is dealt out
by itself. The ``CROWDS`` most frequent of these hashes at most are broadcast.

Defined cases: ids are compared as longs; rows with a null id keep all bytes and
take none from others; of rows with one id none loses to another; a null text is
empty; texts shorter than K are kept; texts of any length are read whole, and one
beyond a batch is a batch of its own; columns other than those named are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import pieces
from colloquy.llm.common import Batches, arrow_map, drop_path, shared_path, ship_package, text_groups, tidy

K = 50
#: Length of the grams whose least hash stands for a string.
M = 24
#: Starts in a stretch at most.
STRETCH = 256
#: Texts hashed at once, so that the arrays stay in the cache; hashes, and bytes of stretches, that are compared within a task before they are sent.
BLOCK, HASHES_HELD, BYTES_HELD = 1 << 16, 1 << 20, 8 << 20
#: Buckets for each shuffle partition: a task holds one at a time, and works on ``HASHES_HELD`` of its hashes.
BUCKETS = 2
#: Bytes of a bucket's stretches that are held at once and that are compared at once, for which arrays take some 60 times as much; spans, and hashes told, that are put together before they are sent.
BUCKET_HELD, COMPARED, SPANS_HELD, TOLD_HELD = 32 << 20, 2 << 20, 1 << 18, 1 << 20
#: Documents in which a hash is crowded, and hashes that are broadcast as crowded at most (8 bytes each).
CROWD, CROWDS = 4096, 1 << 22
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * TURN
    return x ^ (x >> np.uint64(29))


_BYTE = _scrambled(np.arange(1, 257, dtype=np.uint64) * MIX)


def _powers(m: int) -> list[int]:
    return [1 << i for i in range(m.bit_length()) if m >> i & 1]


def gram_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of every m bytes in a row, put together from hashes of 1, 2, 4, ... bytes."""
    n = len(data) - m + 1
    power, size, out, done = _BYTE[data], 1, None, 0
    for want in _powers(m):
        while size < want:
            power = power[:-size] * (MIX + np.uint64(2 * size)) + power[size:]
            size *= 2
        part = power[done : done + n]
        out = part.copy() if out is None else _scrambled(out * TURN + part)
        done += want
    return _scrambled(out)


def window_least(hashes: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row."""
    n, size, least = len(hashes) - w + 1, 1, hashes
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[w - size : w - size + n])


def least_hashes(data: np.ndarray, k: int = K, m: int = M) -> np.ndarray:
    """For every string of k bytes the least hash of the m-grams in it; texts in a row are not kept apart."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            out[a:b] = window_least(gram_hashes(data[a : b + k - 1], m), k - m + 1)
    return out


def whole_hash(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at each place."""
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out + _BYTE[data[at + j]]) * MIX
    return _scrambled(out)


def stretches(least: np.ndarray, bounds: np.ndarray, k: int, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, end, row)``: starts in a row with one least hash, ``STRETCH`` at most, of texts at ``bounds``.

    Those of the sorted hashes ``single`` are stretches of one start each.
    """
    size, n = len(least), np.diff(bounds)
    begins, ends = bounds[:-1][n >= k], bounds[1:][n >= k] - k + 1
    fresh = np.ones(size, dtype=bool)
    fresh[1:] = least[1:] != least[:-1]
    if single is not None and len(single):
        where = np.searchsorted(single, least)
        fresh |= single[np.minimum(where, len(single) - 1)] == least
    fresh[begins] = True
    change = np.zeros(size + 1, dtype=np.int8)
    change[begins] += 1
    change[ends] -= 1
    valid = np.cumsum(change[:size], dtype=np.int8) > 0
    first = np.flatnonzero(fresh & valid)
    row = np.searchsorted(bounds, first, "right") - 1
    end = np.minimum(np.append(first[1:], size), bounds[row + 1] - k + 1)
    many = -(-(end - first) // STRETCH)
    if len(many) and many.max() > 1:
        start = np.repeat(first, many) + STRETCH * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        first, end, row = start, np.minimum(start + STRETCH, np.repeat(end, many)), np.repeat(row, many)
    return first, end, row


# packing: rows of a bucket as columns of bytes


def _short(w: np.ndarray) -> np.ndarray:
    """The upper half of hashes: enough to know one again, as a false match only brings more to compare. Buckets are dealt by the lower half."""
    return (w >> np.uint64(32)).astype("<u4")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the differences of neighbours, all first bytes first: small steps leave long zeros, which compress."""
    return np.diff(x.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _groups(x: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, with the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, np.int64)


def _by_bucket(batches: Batches) -> Iterator[list[dict]]:
    """The rows of each bucket of a task, in which buckets are sorted."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _append(rows: dict[str, list], **values) -> None:
    for name, value in values.items():
        rows[name].append(value)


# first round

#: Pairs of id and hash in a row that is passed on.
PASSED = 1 << 16
HASHES = pa.schema([("bucket", pa.int32()), ("w", pa.binary()), ("ids", pa.binary()), ("many", pa.binary())])
TOLD = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("w", pa.binary()), ("n", pa.binary())])
TOLD_TYPE = "bucket int, ids binary, w binary, n binary"


def _send_hashes(batches: Batches, k: int, m: int, buckets: int) -> Batches:
    """Per bucket: hashes, with the id of the only document here that has them, or the number of those that do."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, count
        w, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        held, count = [], 0
        order = np.argsort(w, kind="stable")
        w, ids = w[order], ids[order]
        edge = _groups(w)
        many = np.diff(edge)
        rows: dict[str, list] = {n: [] for n in HASHES.names}
        # Of hashes that several documents here have, all are told already; rows of any bucket pass that on.
        several = np.flatnonzero(np.repeat(many > 1, many))
        several = several[np.argsort(ids[several], kind="stable")]
        for a in range(0, len(several), PASSED):
            part = several[a : a + PASSED]
            spread = _scrambled(ids[part[:1]].astype(np.uint64) + np.uint64(a))
            _append(rows, bucket=int(_bucket_of(spread, buckets)[0]), w=_short(w[part]).tobytes(), ids=_planes(ids[part]), many=None)
        w, ids = w[edge[:-1]], ids[edge[:-1]]
        # In a bucket those of one document come first, by id.
        bucket = _bucket_of(w, buckets)
        order = np.lexsort((ids, many > 1, bucket))
        w, ids, many, bucket = w[order], ids[order], many[order], bucket[order]
        cuts = _groups(bucket)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            one = a + int(np.count_nonzero(many[a:b] == 1))
            _append(rows, bucket=int(bucket[a]), w=w[a:b].tobytes(), ids=_planes(ids[a:one]), many=many[one:b].astype("<u4").tobytes())
        return pa.RecordBatch.from_pydict(rows, HASHES)

    for batch in text_groups(batches, "text", 4 << 20):
        ids = batch.column(0).to_numpy()
        data, bounds = pieces.raw(batch.column(1))
        least = least_hashes(data, k, m)
        if not len(least):
            continue
        first, _, row = stretches(least, bounds, k)
        w = least[first]
        order = np.lexsort((w, row))
        w, row = w[order], row[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
        if new.any():
            held.append((w[new], ids[row[new]]))
            count += int(new.sum())
        if count >= HASHES_HELD:
            yield flush()
    if count:
        yield flush()


def _told(ids: np.ndarray, w: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs of id and upper half of a hash, dealt by id."""
    bucket = _bucket_of(_scrambled(ids.astype(np.uint64)), buckets)
    order = np.lexsort((ids, bucket))
    ids, w, bucket = ids[order], w[order], bucket[order]
    cuts = _groups(bucket)
    if len(ids):
        rows = [(int(bucket[a]), _planes(ids[a:b]), w[a:b].tobytes(), None) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TOLD.types, strict=True)], TOLD.names)


def _answer(batches: Batches, crowd: int, buckets: int) -> Batches:
    """Pairs of a document's id and a hash that other documents have too; with a null bucket the hashes of ``crowd`` documents or more, and how many have them."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def full_up() -> bool:
        return sum(len(w) for _, w in found) >= TOLD_HELD

    def flush() -> Iterator[pa.RecordBatch]:
        out = tuple(map(np.concatenate, zip(*found, strict=True)))
        found.clear()
        yield from _told(*out, buckets)

    for rows in _by_bucket(batches):
        for r in rows:
            if r["many"] is None:
                found.append((_unplaned(r["ids"]), np.frombuffer(r["w"], "<u4")))
                if full_up():
                    yield from flush()
        rows = [r for r in rows if r["many"] is not None]
        slices = 1 << max(0, sum(len(r["w"]) for r in rows) // 8 // HASHES_HELD).bit_length()
        for part in range(slices):
            w, ids, known, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for r in rows:
                own, several = _unplaned(r["ids"]), np.frombuffer(r["many"], "<u4")
                hashes = np.frombuffer(r["w"], np.uint64)
                mine = hashes & np.uint64(slices - 1) == part
                w.append(hashes[mine])
                ids.append(np.concatenate([own, np.zeros(len(several), np.int64)])[mine])
                known.append((np.arange(len(hashes)) < len(own))[mine])
                many.append(np.concatenate([np.ones(len(own), np.int64), several])[mine])
            w, ids, known, many = np.concatenate(w), np.concatenate(ids), np.concatenate(known), np.concatenate(many)
            order = np.argsort(w, kind="stable")
            w, ids, known, many = w[order], ids[order], known[order], many[order]
            edge = _groups(w)
            if not len(w):
                continue
            total = np.add.reduceat(many, edge[:-1])
            told = known & np.repeat(total > 1, np.diff(edge))
            found.append((ids[told], _short(w[told])))
            full = np.flatnonzero(total >= crowd)
            if len(full):
                crowds = [(None, None, w[edge[:-1]][full].tobytes(), total[full].astype("<i8").tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*crowds, strict=True), TOLD.types, strict=True)], TOLD.names)
            if full_up():
                yield from flush()
    if found:
        yield from flush()


#: Texts on their way to where their documents' hashes are told, by bucket of the id; ``w`` is that of what is told, null in rows of texts.
TEXTS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("w", pa.binary()), ("h", pa.binary()), ("size", pa.binary()), ("x", pa.binary()), ("raw", pa.int64())])
TEXTS_TYPE = "bucket int, ids binary, w binary, h binary, size binary, x binary, raw long"
#: Bytes of texts that are packed at once.
PACKED = 16 << 20


def _send_texts(batches: Batches, buckets: int) -> Batches:
    """``(id, text, h)`` by bucket of the id: the texts of a bucket are compressed together, to much less than each by itself."""
    held: list[pa.RecordBatch] = []
    count = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, count
        table = pa.Table.from_batches(held).combine_chunks()
        held, count = [], 0
        ids, h = table.column(0).to_numpy(), table.column(2).to_numpy()
        data, bounds = pieces.raw(table.column(1).cast(pa.large_string()).combine_chunks())
        bucket = _bucket_of(_scrambled(ids.astype(np.uint64)), buckets)
        order = np.lexsort((ids, bucket))
        first, sizes = bounds[:-1][order], np.diff(bounds)[order]
        ids, h, bucket = ids[order], h[order], bucket[order]
        cuts = _groups(bucket)
        rows: dict[str, list] = {n: [] for n in TEXTS.names}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x = b"".join(data[i : i + n].tobytes() for i, n in zip(first[a:b].tolist(), sizes[a:b].tolist(), strict=True))
            _append(rows, bucket=int(bucket[a]), ids=_planes(ids[a:b]), w=None, h=h[a:b].astype("<u4").tobytes(), size=sizes[a:b].astype("<i8").tobytes(), x=pa.compress(x, "zstd", asbytes=True), raw=len(x))
        return pa.RecordBatch.from_pydict(rows, TEXTS)

    for batch in text_groups(batches, "text", PACKED):
        size = batch.column(1).nbytes
        if held and count + size > PACKED:
            yield flush()
        held.append(batch)
        count += size
    if held:
        yield flush()


def _told_texts(batches: Batches, limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(ids, h, data, bounds, rows, told)``: texts, about ``limit`` bytes at a time, with the hashes told to each as pairs of its place and a hash; a bucket's hashes come before its texts."""
    bucket, told_ids, told_w = None, np.zeros(0, np.int64), np.zeros(0, "<u4")
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> tuple[np.ndarray, ...]:
        nonlocal held
        ids, h, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
        held = []
        low, high = np.searchsorted(told_ids, ids, "left"), np.searchsorted(told_ids, ids, "right")
        many = high - low
        at = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return ids, h, data, np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(len(ids)), many), told_w[at]

    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(j)[i].as_py() for j, n in enumerate(TEXTS.names)}
            if r["bucket"] != bucket:
                if held:
                    yield flush()
                bucket, open_, told_ids, told_w = r["bucket"], [], np.zeros(0, np.int64), np.zeros(0, "<u4")
            if r["w"] is not None:
                open_.append((_unplaned(r["ids"]), np.frombuffer(r["w"], "<u4")))
                continue
            if open_:
                told_ids, told_w = map(np.concatenate, zip(*open_, strict=True))
                order, open_ = np.argsort(told_ids, kind="stable"), []
                told_ids, told_w = told_ids[order], told_w[order]
            ids, h, sizes = _unplaned(r["ids"]), np.frombuffer(r["h"], "<u4"), np.frombuffer(r["size"], "<i8")
            some = np.flatnonzero(np.searchsorted(told_ids, ids, "right") > np.searchsorted(told_ids, ids, "left"))
            if not len(some):
                continue
            data = np.frombuffer(pa.decompress(r["x"], r["raw"], "zstd", asbytes=True), np.uint8)
            first = (np.cumsum(sizes) - sizes)[some]
            ends = np.cumsum(sizes[some])
            # About ``limit`` bytes at a time.
            group = (ends - sizes[some]) // limit
            for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(group)) + 1):
                if held and sum(len(x[3]) for x in held) + int(sizes[some[part]].sum()) > limit:
                    yield flush()
                held.append((ids[some[part]], h[some[part]], sizes[some[part]], _gather(data, first[part], sizes[some[part]])))
    if held:
        yield flush()


# second round


def _gather(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(data)) < 1 << 31 else np.int64
    where = np.repeat((first - (ends - sizes)).astype(kind), sizes)
    where += np.arange(total, dtype=kind)
    return data[where]


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _distinct(flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code, example, least)``: a number for each stretch by its bytes, one stretch of each number, and its least id."""
    code = _binary(flat, sizes).dictionary_encode().indices.to_numpy()
    least = np.full(int(code.max()) + 1 if len(code) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids)
    example = np.zeros(len(least), dtype=np.int64)
    example[code[::-1]] = np.arange(len(code))[::-1]
    return code, example, least


STRETCHES = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("ids", pa.binary()), ("h", pa.binary()), ("at", pa.binary()), ("size", pa.binary()), ("x", pa.binary()), ("raw", pa.int64())])
SPANS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("h", pa.binary()), ("start", pa.binary()), ("size", pa.binary())])
SPANS_TYPE = "bucket int, ids binary, h binary, start binary, size binary"
STRETCHES_TYPE = "bucket int, key binary, ids binary, h binary, at binary, size binary, x binary, raw long"


def _send_stretches(batches: Batches, k: int, m: int, buckets: int, crowded: np.ndarray) -> Batches:
    """Per bucket the stretches with hashes that other documents have, those of the least id here; the others are covered, which rows without bytes tell, as spans united and dealt evenly."""
    held: list[tuple] = []
    count = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, count
        key, ids, h, at, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        held, count = [], 0
        code, _, least = _distinct(flat, sizes, ids)
        later = ids > least[code]
        starts = np.cumsum(sizes) - sizes
        bucket = _bucket_of(key, buckets)
        order = np.lexsort((at, ids, later, bucket))
        # A row that is repeated here is sent once.
        o = order
        twice = np.zeros(len(o), dtype=bool)
        twice[1:] = (ids[o][1:] == ids[o][:-1]) & (h[o][1:] == h[o][:-1]) & (at[o][1:] == at[o][:-1]) & (key[o][1:] == key[o][:-1])
        o = o[~twice]
        covered, o = o[later[o]], o[~later[o]]
        rows: dict[str, list] = {n: [] for n in STRETCHES.names}

        def add(where: int, key: np.ndarray, ids: np.ndarray, h: np.ndarray, at: np.ndarray, sizes: np.ndarray, x: bytes) -> None:
            _append(
                rows, bucket=where, key=_short(key).tobytes(), ids=_planes(ids), h=h.astype("<u4").tobytes(), at=_planes(at),
                size=sizes.astype("<u4").tobytes(), x=pa.compress(x, "zstd", asbytes=True) if x else b"", raw=len(x),
            )

        cuts = _groups(bucket[o])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = o[a:b]
            add(int(bucket[own[0]]), key[own], ids[own], h[own], at[own], sizes[own], _gather(flat, starts[own], sizes[own]).tobytes())
        # Any bucket passes these on, so they are dealt by chance: by their own buckets most would go to the first.
        gone = _united_by_text(ids[covered], h[covered], at[covered], (at + sizes)[covered])
        for a in range(0, len(gone[0]), PASSED):
            i, g, start, end = (x[a : a + PASSED] for x in gone)
            spread = _scrambled(i[:1].astype(np.uint64) * MIX + start[:1].astype(np.uint64))
            add(int(_bucket_of(spread, buckets)[0]), key[:0], i, g, start, end - start, b"")
        return pa.RecordBatch.from_pydict(rows, STRETCHES)

    for ids, h, data, bounds, pairs_row, pairs_w in _told_texts(batches, 1 << 20):
        least = least_hashes(data, k, m)
        if not len(least):
            continue
        first, end, row = stretches(least, bounds, k, crowded)
        w = least[first]
        wanted = _isin_pairs(row, _short(w), pairs_row, pairs_w)
        first, end, row, w = first[wanted], end[wanted], row[wanted], w[wanted]
        if not len(first):
            continue
        if len(crowded):
            full = np.flatnonzero(crowded[np.minimum(np.searchsorted(crowded, w), len(crowded) - 1)] == w)
            w[full] = whole_hash(data, first[full], k)
        sizes = end - first + k - 1
        flat = _gather(data, first, sizes)
        held.append((w, ids[row], h[row], first - bounds[row], sizes, flat))
        count += len(flat)
        if count >= BYTES_HELD:
            yield flush()
    if count:
        yield flush()


def _isin_pairs(row: np.ndarray, w: np.ndarray, rows: np.ndarray, ws: np.ndarray) -> np.ndarray:
    """Whether ``(row, w)`` is one of the pairs ``(rows, ws)``."""
    both_row, both_w = np.concatenate([rows, row]), np.concatenate([ws, w])
    order = np.lexsort((both_w, both_row))  # stable: the given pairs come first
    r, x = both_row[order], both_w[order]
    fresh = np.ones(len(r), dtype=bool)
    fresh[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    given = order < len(rows)
    good = np.repeat(given[np.flatnonzero(fresh)], np.diff(np.append(np.flatnonzero(fresh), len(r))))
    out = np.zeros(len(both_row), dtype=bool)
    out[order] = good
    return out[len(rows) :]


def suffix_classes(flat: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, fresh)``: the suffixes at ``at`` in the order of their first k bytes, and where these differ from those before.

    Words of eight bytes get ranks; suffixes are compared by the ranks of the words that make up k bytes, the last of which may overlap the one before.
    """
    word = np.zeros(len(flat), dtype=np.uint64)
    step = min(8, k)
    for j in range(step):
        word[: len(flat) - j] |= flat[j:].astype(np.uint64) << np.uint64(8 * (7 - j))
    offsets = [*range(0, k - step, step), k - step]
    order = np.argsort(word, kind="stable")
    rank = np.empty(len(flat), dtype=np.int64)
    sorted_words = word[order]
    rank[order] = np.cumsum(np.concatenate([[0], sorted_words[1:] != sorted_words[:-1]]))
    bits = max(1, int(rank.max()).bit_length())
    keys, per = [], max(1, 62 // bits)
    for i in range(0, len(offsets), per):
        key = np.zeros(len(at), dtype=np.int64)
        for offset in offsets[i : i + per]:
            key = (key << bits) | rank[at + offset]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in keys])
    return order, fresh


def previous_factors(flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(stretch, place)`` of the suffixes whose longest previous factor, with a document of smaller id, has k bytes or more."""
    many = sizes - k + 1
    stretch = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    order, fresh = suffix_classes(flat, np.repeat(np.cumsum(sizes) - sizes, many) + place, k)
    own = ids[stretch[order]]
    group = np.cumsum(fresh) - 1
    by_position = np.lexsort((own, group))
    order, own = order[by_position], own[by_position]
    # Among equals in order of documents, the previous smaller position is the one before, or that one's if the document is the same.
    smaller = np.arange(len(order)) - 1
    same = np.concatenate([[False], (own[1:] == own[:-1]) & (group[1:] == group[:-1])])
    smaller = np.maximum.accumulate(np.where(same, -1, smaller))
    first = np.flatnonzero(fresh)[group]
    met = order[smaller >= first]
    return stretch[met], place[met]


def _united_by_text(ids: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(ids, h, start, end)``: the spans of each text in order and apart from each other."""
    order = np.lexsort((a, h, ids))
    ids, h, a, b = ids[order], h[order], a[order], b[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])
    # Places are below 2^31, so those of one text stay below the next one's.
    base = np.cumsum(fresh) << 32
    reach = np.maximum.accumulate(base + b)
    fresh[1:] |= (base + a)[1:] > reach[:-1]
    new = np.flatnonzero(fresh)
    last = np.append(new[1:], len(ids))[: len(new)] - 1
    return ids[new], h[new], a[new], (reach - base)[last]


def _held_stretches(rows: list[dict], part: int, parts: int) -> tuple[np.ndarray, ...]:
    """``(key, ids, h, at, sizes, flat)`` of a bucket's stretches whose keys are in one of equal parts of all."""
    out = []
    for r in rows:
        key, sizes = np.frombuffer(r["key"], "<u4"), np.frombuffer(r["size"], "<u4").astype(np.int64)
        own = [key, _unplaned(r["ids"]), np.frombuffer(r["h"], "<u4"), _unplaned(r["at"]), sizes]
        flat = np.frombuffer(pa.decompress(r["x"], r["raw"], "zstd", asbytes=True), np.uint8)
        if parts > 1:
            mine = np.flatnonzero(_part_of(key, parts) == part)
            flat = _gather(flat, (np.cumsum(sizes) - sizes)[mine], sizes[mine])
            own = [x[mine] for x in own]
        out.append((*own, flat))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _spans_of(rows: list[dict], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(ids, h, start, end)`` of what is covered in a bucket: its stretches are held and compared by parts of their keys, so no array grows with it."""
    total = sum(r["raw"] for r in rows)
    parts = max(1, -(-total // BUCKET_HELD))
    for part in range(parts):
        key, ids, h, at, sizes, flat = _held_stretches(rows, part, parts)
        slices = parts * max(1, -(-len(flat) // COMPARED))
        of = _part_of(key, slices)
        order = np.argsort(of, kind="stable")
        starts = np.cumsum(sizes) - sizes
        cuts = _groups(of[order])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[a:b]
            yield from _spans_of_slice(key[own], ids[own], h[own], at[own], sizes[own], _gather(flat, starts[own], sizes[own]), k)


def _spans_of_slice(key: np.ndarray, ids: np.ndarray, h: np.ndarray, at: np.ndarray, sizes: np.ndarray, flat: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    code, example, least = _distinct(flat, sizes, ids)
    later = ids > least[code]
    yield ids[later], h[later], at[later], (at + sizes)[later]
    # Distinct stretches that share their hash with another: their suffixes are sorted.
    key_of = key[example]
    _, inverse, times = np.unique(key_of, return_inverse=True, return_counts=True)
    pick = np.flatnonzero(times[inverse] > 1)
    if len(pick):
        starts = np.cumsum(sizes) - sizes
        own = example[pick]
        s, place = previous_factors(_gather(flat, starts[own], sizes[own]), sizes[own], least[pick], k)
        order = np.lexsort((place, s))
        s, place = s[order], place[order]
        # Neighbouring starts are one span.
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (place[1:] > place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s))[: len(first)] - 1
        owner, a, b = pick[s[first]], place[first], place[last] + k
        # Every occurrence of the stretch in its least document.
        rank = np.argsort(np.where(later, len(least), code), kind="stable")
        sorted_code = np.where(later, len(least), code)[rank]
        low, high = np.searchsorted(sorted_code, owner, "left"), np.searchsorted(sorted_code, owner, "right")
        many = high - low
        which = rank[np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
        yield ids[which], h[which], at[which] + np.repeat(a, many), at[which] + np.repeat(b, many)


def _find(batches: Batches, k: int, buckets: int) -> Batches:
    """Rows ``(id, h, start, end)`` of what is covered, dealt by id; rows without bytes tell it already and are not held."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, count
        ids, h, a, b = _united_by_text(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held, count = [], 0
        bucket = _bucket_of(_scrambled(ids.astype(np.uint64)), buckets)
        order = np.argsort(bucket, kind="stable")
        ids, h, a, b, bucket = ids[order], h[order], a[order], b[order], bucket[order]
        cuts = _groups(bucket)
        told = [(int(bucket[i]), _planes(ids[i:j]), h[i:j].astype("<u4").tobytes(), _planes(a[i:j]), _planes(b[i:j] - a[i:j])) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), SPANS.types, strict=True)], SPANS.names)

    def compared(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for found in _spans_of(rows, k):
            yield from hold(found)

    def hold(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        nonlocal count
        held.append(found)
        count += len(found[0])
        if count >= SPANS_HELD:
            yield from flush()

    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if not r["raw"]:
                at = _unplaned(r["at"])
                yield from hold((_unplaned(r["ids"]), np.frombuffer(r["h"], "<u4"), at, at + np.frombuffer(r["size"], "<u4").astype(np.int64)))
                continue
            if rows and rows[0]["bucket"] != r["bucket"]:
                yield from compared(rows)
                rows = []
            rows.append(r)
    if rows:
        yield from compared(rows)
    if count:
        yield from flush()


def _spans_by_id(batches: Batches) -> Batches:
    """``(id, h, spans)``: all spans of a text, in one row, as pairs of longs."""
    for rows in _by_bucket(batches):
        parts = max(1, -(-sum(len(r["h"]) // 4 for r in rows) // (4 * SPANS_HELD)))
        for part in range(parts):
            held = []
            for r in rows:
                ids, a = _unplaned(r["ids"]), _unplaned(r["start"])
                own = (ids, np.frombuffer(r["h"], "<u4").astype(np.int64), a, a + _unplaned(r["size"]))
                mine = _part_of(_short(_scrambled(ids.astype(np.uint64))), parts) == part
                held.append(own if parts == 1 else tuple(x[mine] for x in own))
            ids, h, a, b = _united_by_text(*(np.concatenate(x) for x in zip(*held, strict=True)))
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])
            cuts = np.append(np.flatnonzero(new), len(ids)) if len(ids) else np.zeros(1, np.int64)
            pairs = np.stack([a, b], axis=1).astype("<i8")
            blobs = _binary(pairs.view(np.uint8).ravel(), np.diff(cuts) * 16).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), pa.array(h[cuts[:-1]]), blobs], ["id", "h", "spans"])


def _united(pairs: np.ndarray) -> np.ndarray:
    """Spans in order and apart from each other."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.stack([pairs[new, 0], reach[np.append(new[1:], len(pairs)) - 1]], axis=1)


def _without(batches: Batches) -> Batches:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in text_groups(batches, "text", 4 << 20):
        sizes, removed, spans, kept = [], [], [], []
        for text, blob in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
            data = text.as_py() or b""
            own = _united(np.frombuffer(blob, "<i8").reshape(-1, 2)).tolist() if blob else []
            edges = [0, *(x for s in own for x in s), len(data)]
            sizes.append(len(data))
            removed.append(sum(b - a for a, b in own))
            spans.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])


def _counted(batches: Batches) -> Batches:
    for batch in batches:
        w, n = (b"".join(batch.column(i).to_pylist()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["w", "n"])


def _written(rows: DataFrame, path: str) -> DataFrame:
    """The rows as a table in the shared folder: nothing of how they were made is held on to, so its shuffles can go."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def repeated_spans(rows: DataFrame, k: int = K, crowd: int = CROWD, crowds: int = CROWDS) -> DataFrame:
    """``(id, h, spans)`` of rows ``(id, text, h)``: what to remove, as blobs of pairs of byte places."""
    spark = rows.sparkSession
    ship_package(spark)
    m = max(1, min(M, k // 2))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.where(f"id is not null and octet_length(text) >= {k}")

    def dealt(sent: DataFrame) -> DataFrame:
        return sent.repartition("bucket").sortWithinPartitions("bucket")

    sent = arrow_map(known.select("id", "text"), lambda b: _send_hashes(b, k, m, buckets), "bucket int, w binary, ids binary, many binary")
    path = shared_path(spark, "repeated-hashes")
    answers = _written(arrow_map(dealt(sent), lambda b: _answer(b, crowd, buckets), TOLD_TYPE), path)
    del sent
    tidy(spark)
    full = arrow_map(answers.where("bucket is null").select("w", "n"), _counted, "w long, n long")
    most = full.orderBy(F.col("n").desc(), "w").limit(crowds).select("w").toArrow()  # 8 bytes each; the rest of these groups stays whole
    crowded = spark.sparkContext.broadcast(np.sort(most.column(0).to_numpy().view(np.uint64)))
    told = answers.where("bucket is not null").select("bucket", "ids", "w", *[F.lit(None).cast(t).alias(n) for n, t in (("h", "binary"), ("size", "binary"), ("x", "binary"), ("raw", "long"))])
    texts = arrow_map(known.select("id", "text", "h"), lambda b: _send_texts(b, buckets), TEXTS_TYPE)
    asked = told.unionByName(texts).repartition("bucket").sortWithinPartitions("bucket", F.col("w").isNull())
    stretches_sent = arrow_map(asked, lambda b: _send_stretches(b, k, m, buckets, crowded.value), STRETCHES_TYPE)
    found = _written(arrow_map(dealt(stretches_sent), lambda b: _find(b, k, buckets), SPANS_TYPE), shared_path(spark, "repeated-spans"))
    drop_path(spark, path)
    return arrow_map(dealt(found), _spans_by_id, "id long, h long, spans binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, crowd: int = CROWD, crowds: int = CROWDS) -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept)`` for every row of ``docs``; ``spans`` are half-open ranges of bytes, ``kept`` the bytes that are left."""
    if not 1 <= k <= 1 << 20:
        raise ValueError("k must be 1 to 2^20")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"))
    spans = repeated_spans(rows, k, crowd, crowds)
    tidy(docs.sparkSession)
    return arrow_map(rows.join(spans, ["id", "h"], "left").select("id", "text", "spans"), _without, "id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
