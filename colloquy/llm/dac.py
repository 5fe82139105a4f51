"""Token files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk of
every id; level j + 1 holds the next chunk of those ids that have one, in the
same order. A bitmap per level tells which ids go on, and a rank directory (ones
before each block of ``BLOCK`` bits) tells where: the id at place i of a level
goes on at place rank(i) of the next. So any id is read with one directory
entry, at most ``BLOCK`` bits and one chunk per level, and no block is decoded;
a run of ids is a run of chunks on every level.

A file, little-endian::

    magic         8 bytes  b"CLQDAC01"
    n_docs        u64
    n_tokens      u64
    levels        u64
    per level     u64 x 4: ids on it, and the offsets of chunks, bitmap, directory
    doc ids       n_docs x i64, then n_docs x u8 (1: the id is null)
    doc starts    (n_docs + 1) x u64, in ids of this file
    sections      chunks (u8), bitmap (low bit first), directory (u64), level by level

Defined cases: a null text counts as empty and holds the end id alone; rows of
one id follow each other, ordered by a hash of their text; null ids come first;
an empty table gives no files and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import pieces
from colloquy.llm.common import arrow_map, cut, kept, ship_package, text_groups

MAGIC = b"CLQDAC01"
BLOCK = 512
#: A task starts another file beyond so many ids, which bounds what it holds.
IDS_PER_FILE = 1 << 23
IDS_AT_ONCE = 1 << 20
#: Pieces of text that a worker remembers with their ids.
REMEMBERED = 600_000


# the codes


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and rank directory of each level of uint32 ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        ones = np.concatenate([[0], np.cumsum(more, dtype=np.uint64)])
        directory = np.ascontiguousarray(ones[:: BLOCK][: len(rest) // BLOCK + 1]).astype("<u8")
        levels.append(((rest & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little"), directory))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def file_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file: ``starts`` has the first place of each document, and the number of ids."""
    levels = encode_levels(ids)
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = len(MAGIC) + 24 + 32 * len(levels)
    tables = known.tobytes() + np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes() + starts.astype("<u8").tobytes()
    at, entries, body = head + len(tables), [], []
    for chunks, bitmap, directory in levels:
        places = []
        for part in (chunks, bitmap, directory):
            data = part.tobytes()
            places.append(at)
            body.append(data)
            at += len(data)
        entries.append(struct.pack("<4Q", len(chunks), *places))
    return b"".join([MAGIC, struct.pack("<3Q", len(doc_ids), len(ids), len(levels)), *entries, tables, *body])


class DacReader:
    """Random access to a file's ids; ``source`` has ``read_at(nbytes, offset)``."""

    def __init__(self, source):
        self.read = lambda n, at: bytes(source.read_at(n, at)) if n else b""
        head = self.read(len(MAGIC) + 24, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, n = struct.unpack("<3Q", head[len(MAGIC) :])
        at = len(MAGIC) + 24
        self.levels = [struct.unpack("<4Q", self.read(32, at + 32 * i)) for i in range(n)]
        self.tables = at + 32 * n

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The document ids, and the first place of each with the number of ids at the end."""
        data = self.read(self.n_docs * 9 + (self.n_docs + 1) * 8, self.tables)
        ids = np.frombuffer(data, "<i8", self.n_docs)
        null = np.frombuffer(data, np.uint8, self.n_docs, self.n_docs * 8)
        starts = np.frombuffer(data, "<u8", self.n_docs + 1, self.n_docs * 9).astype(np.int64)
        return [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)], starts

    def rank(self, level: int, place: int) -> int:
        """Ids before ``place`` on ``level`` that go on to the next level."""
        _, _, bitmap, directory = self.levels[level]
        block = place // BLOCK
        ones = struct.unpack("<Q", self.read(8, directory + 8 * block))[0]
        first, bits = block * BLOCK // 8, place - block * BLOCK
        held = int.from_bytes(self.read((bits + 7) // 8, bitmap + first), "little")
        return ones + (held & ((1 << bits) - 1)).bit_count()

    def token(self, place: int) -> int:
        """The id at ``place``, without decoding any other."""
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = 0
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            value |= self.read(1, chunks + place)[0] << (8 * level)
            if not self.read(1, bitmap + place // 8)[0] >> (place % 8) & 1:
                return value
            place = self.rank(level, place)
        raise ValueError("an id goes on beyond the last level")

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids at places ``start`` to ``end``, as uint32."""
        out = np.zeros(end - start, dtype=np.uint32)
        where = np.arange(end - start)
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            if end <= start:
                break
            out[where] |= np.frombuffer(self.read(end - start, chunks + start), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            bits = np.unpackbits(np.frombuffer(self.read((end + 7) // 8 - first, bitmap + first), np.uint8), bitorder="little")
            where = where[bits[start - 8 * first : end - 8 * first].astype(bool)]
            start = self.rank(level, start)
            end = start + len(where)
        return out


# encoding text with the tokenizers library


class PieceEncoder:
    """The tokenizers library's ids, each distinct piece of text being encoded once.

    Texts are cut where a byte-level pre-tokenizer begins a new token whatever
    stands around (``pieces.spaced_pieces``). The distinct pieces that are not
    remembered go to the library in one call; the ids of all occurrences are
    then gathered from one array. Texts that hold a special token, or white
    space beyond ASCII, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # White space beyond ASCII, and characters that some count as such.
        spaces = "\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.odd = "|".join([f"[{spaces}]", *map(re.escape, added)])
        self.known = pieces.Remembered(lambda names: [e.ids for e in self.tokenizer.encode_batch_fast([n.decode() for n in names], add_special_tokens=False)], REMEMBERED)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def column(self, texts: pa.Array, end_id: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by ``end_id``, and where each begins, with the end of the last."""
        whole = texts.fill_null("")
        odd = pc.match_substring_regex(whole, self.odd)
        own: dict[int, np.ndarray] = {}
        if pc.any(odd).as_py():
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
            own = dict(zip(rows, self._library(whole.filter(odd).to_pylist()), strict=True))
            whole = pc.if_else(odd, "", whole)
        data, bounds = pieces.raw(whole)
        ids, starts = self.known.of(data, pieces.spaced_pieces(data, bounds), bounds)
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        parts = [x for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)) for x in (own[i] if i in own else ids[a:b], tail)]
        sizes = np.diff(starts) + len(tail)
        for i, x in own.items():
            sizes[i] = len(x) + len(tail)
        return np.concatenate(parts) if parts else ids, np.concatenate([[0], np.cumsum(sizes)])

    def texts(self, texts: list[str | None], end_id: int | None = 0) -> list[np.ndarray]:
        """The ids of each text, followed by ``end_id``."""
        ids, starts = self.column(pa.array(texts, pa.string()), end_id)
        return np.split(ids, starts[1:-1]) if len(texts) else []


def encoder(path: str) -> PieceEncoder:
    return kept(f"byte pieces {path}", lambda: PieceEncoder(path))


# files


def open_folder(path: str):
    """``(file system, folder)`` of a path or URI, for executors and the driver alike."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every text and write token files into ``folder``, in ascending order of ids.

    Returns ``(path, start, n_docs, n_tokens)`` of each file, of up to
    ``IDS_PER_FILE`` ids; ``start`` is the number of ids in the files before it.
    The list is a table in the shared folder; the driver gathers one sum a task.
    A task that runs twice writes files of other names; only those of the
    attempt that Spark accepts are listed.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    ordered = keyed.repartitionByRange("id", "h", "n").sortWithinPartitions("id", "h", "n").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        encode, part, attempt = encoder(tokenizer_path), TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        wide = np.uint16 if encode.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        count = file_no = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, sizes, count, file_no
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            name = f"tokens-{part:06d}-{file_no:04d}-{attempt}.dac"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(ids, starts, np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"part": [part], "file_no": [file_no], "path": [f"{folder}/{name}"], "n_docs": [len(ids)], "n_tokens": [int(starts[-1])]})
            ids, held, sizes, count, file_no = [], [], [], 0, file_no + 1
            return row

        for batch in text_groups(batches, "text", 4 << 20):
            ids += batch.column(0).to_pylist()
            new, starts = encode.column(batch.column(1), end_id)
            held.append(new.astype(wide))
            sizes.append(np.diff(starts))
            count += len(new)
            if count >= IDS_PER_FILE:
                yield flush()
        if ids:
            yield flush()

    listed = cut(arrow_map(ordered, run, "part long, file_no long, path string, n_docs long, n_tokens long"))
    sums = {r["part"]: r["n"] for r in listed.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    parts = sorted(sums)
    before = np.cumsum([0, *(sums[p] for p in parts)])[:-1].tolist()
    bases = docs.sparkSession.createDataFrame(list(zip(parts, before, strict=True)), "part long, base long")
    inside = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return listed.join(bases, "part").select("path", start.alias("start"), "n_docs", "n_tokens")


def read_digests(files: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, read from the files ``(path, start)``."""
    listed = files.select("path", "start")
    # A task for each few files: reading is the work, so they are dealt out by their names.
    listed = listed.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, own_path = open_folder(path)
                with system.open_input_file(own_path) as source:
                    reader = DacReader(source)
                    docs, starts = reader.documents()
                    at = 0
                    while at < len(docs):
                        to = max(at + 1, int(np.searchsorted(starts, starts[at] + IDS_AT_ONCE, "right")) - 1)
                        ids = reader.tokens(int(starts[at]), int(starts[to])).astype("<u4", copy=False)
                        own = starts[at : to + 1] - starts[at]
                        sums = [zlib.crc32(ids[own[i] : own[i + 1]]) for i in range(to - at)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs[at:to], pa.int64()), pa.array(starts[at:to] + base, pa.int64()), pa.array(np.diff(own), pa.int64()), pa.array(sums, pa.int64())],
                            ["id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = to

    return arrow_map(listed, run, "id long, start long, n_tokens long, ids_crc32 long")
