"""Cutting texts where the tokenizers here begin a new token, on Arrow buffers.

A byte of a text is a letter (ASCII, or one of the letters of Latin-1), a digit,
a mark (any other printable ASCII character), white space, or unknown. A cut is
made only between bytes whose classes leave no doubt, so every piece can be
tokenized by itself; whatever touches an unknown byte stays in one piece with
it. Pieces are then told apart once (``dictionary_encode``) and each distinct
one is worked on once, in place of each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

UNKNOWN, LETTER, DIGIT, MARK, SPACE = range(5)
APOSTROPHE, BLANK = 0x27, 0x20


def _kinds() -> np.ndarray:
    table = np.full(256, UNKNOWN, dtype=np.uint8)
    for b in range(0x21, 0x7F):
        table[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    table[list(b"\t\n\v\f\r ")] = SPACE
    return table


_KINDS = _kinds()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, bounds)`` of a column of texts, without a copy where that can be; a null is empty."""
    wide = column.cast(pa.large_binary()).fill_null(b"")
    n = len(wide)
    offsets = np.frombuffer(wide.buffers()[1], np.int64, n + 1, wide.offset * 8) if n else np.zeros(1, np.int64)
    data = wide.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte."""
    out = _KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        second = data[lead + 1]
        lead = lead[(second != 0x97) & (second != 0xB7)]
        out[lead] = out[lead + 1] = LETTER
    return out


def _between(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a cut stands before each byte for the classes of it and the byte before; not after an apostrophe, as of a contraction."""
    out = np.zeros(len(data), dtype=bool)
    known = (kind > UNKNOWN) & (kind < SPACE)
    out[1:] = known[1:] & known[:-1] & (kind[1:] != kind[:-1]) & ~((data[:-1] == APOSTROPHE) & (kind[1:] == LETTER))
    return out


def spaced_pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin if a blank belongs to the piece behind it.

    Of a run of white space all but the last character are a piece, unless the
    run ends the text; a last character that is no blank is a piece of its own.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = kinds(data)
    cut = _between(data, kind)
    space = kind == SPACE
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    after, before = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:] = space[:-1]
    before &= ~first[:n]
    after[:-1] = space[1:]
    ends = first[1:]
    cut |= space & (~before | (~after & ~ends))
    cut[1:] |= ~space[1:] & before[1:] & (data[:-1] != BLANK)
    cut |= first[:n]
    return np.flatnonzero(cut)


def bare_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, bounds)`` in lower case without white space; every digit is a piece of its own."""
    n = len(data)
    kind = kinds(data)
    cut = _between(data, kind)
    digit = kind == DIGIT
    cut[1:] |= digit[1:] & digit[:-1]
    space = kind == SPACE
    cut[1:] |= space[:-1]
    if n:
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] += 0x20
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) if n else np.zeros(0, np.int64)
    lower[lead + 1] += 0x20
    keep = ~space
    places = np.concatenate([[0], np.cumsum(keep)])
    return lower[keep], np.flatnonzero(cut[keep]), places[bounds]


def as_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces as an Arrow array over the same bytes."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(pieces: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and the number of the one that stands at each place."""
    if not len(pieces):
        return [], np.zeros(0, dtype=np.int64)
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of pieces before each text, and in all at the end."""
    return np.searchsorted(starts, bounds, "left")


class Remembered:
    """The ids of distinct pieces in one array, worked out once for each piece while the memory lasts.

    ``encode`` gives the ids of each of a list of pieces. Beyond ``most`` pieces
    those that were met in one batch only are forgotten, or all if most were met
    again; pieces longer than ``longest`` bytes are not found again.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.sizes = np.zeros(1 << 14, dtype=np.int64)
        self.met = np.zeros(1 << 14, dtype=np.int32)
        self.n_pieces = self.n_ids = 0

    def _shrink(self) -> None:
        """Forget what was met once; count anew."""
        keep = {name: i for name, i in self.place.items() if self.met[i] > 1}
        if 2 * len(keep) > self.most:
            self.forget()
            return
        old = np.fromiter(keep.values(), dtype=np.int64, count=len(keep))
        sizes = self.sizes[old]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[old] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.starts, self.sizes, self.met = ends - sizes, sizes, np.zeros(len(old), dtype=np.int32)
        self.n_pieces, self.n_ids = len(old), len(self.ids)
        self.place = dict(zip(keep, range(len(old)), strict=True))

    def places(self, names: list[bytes]) -> np.ndarray:
        """Where the ids of each of the distinct pieces are listed."""
        if self.n_pieces > self.most or self.n_ids > 8 * self.most:
            self._shrink()
        found = list(map(self.place.get, names))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            rows = self.encode([names[i] for i in missing])
            sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            flat = np.fromiter(chain.from_iterable(rows), dtype=np.uint32, count=int(sizes.sum()))
            first, n = self.n_pieces, len(rows)
            self.ids = _room(self.ids, self.n_ids, len(flat))
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.starts, self.sizes, self.met = (_room(x, first, n) for x in (self.starts, self.sizes, self.met))
            self.starts[first : first + n] = self.n_ids + np.cumsum(sizes) - sizes
            self.sizes[first : first + n] = sizes
            self.n_ids, self.n_pieces = self.n_ids + len(flat), first + n
            for j, i in enumerate(missing, first):
                found[i] = j
                if len(names[i]) <= self.longest:
                    self.place[names[i]] = j
        out = np.array(found, dtype=np.int64)
        self.met[out] += 1
        return out

    def of(self, data: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and where each text's begin, with the end of the last."""
        names, which = distinct(as_array(data, starts))
        places = self.places(names)[which] if len(which) else which
        sizes = self.sizes[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[places] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.ids[at], ends[per_text(starts, bounds)]


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a longer one that has room for ``more`` values."""
    if used + more <= len(values):
        return values
    out = np.zeros(max(2 * len(values), used + more), dtype=values.dtype)
    out[:used] = values[:used]
    return out
