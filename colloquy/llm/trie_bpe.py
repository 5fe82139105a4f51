"""BPE encoding and decoding by traversal of a trie of distinct words.

For a byte-pair encoding with ranked merges, the encoding of a prefix is fixed
by its last token: cut that token off, and what remains is the encoding of a
shorter prefix. A token may stand last if the prefix ends with it, it encodes
to itself, and merging it with the token before it would leave both as they
are. So the distinct words of a batch go into a trie, a depth-first walk gives
every node the last token of its prefix, and each word's encoding is read off
by following last tokens back. A prefix that many words share is worked out
once, and the cost is linear in a word's length however long it is.

The tokenizer files that this handles: BPE models whose words end in a suffix
mark, with byte-level symbols; normalisation NFC, white space, lower case; a
pattern that keeps what it matches. Special tokens that occur in a text keep
their own ids, as in the tokenizers library's default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import pieces
from colloquy.llm.common import arrow_map, byte_symbols, kept, ship_package, text_groups

#: Pieces of text that a worker remembers with their ids, and pairs of tokens of which it knows whether they fit.
REMEMBERED, PAIRS = 200_000, 250_000

#: Characters of which Python's ``re`` and the pattern agree on letters, digits and spaces, and which NFC leaves as they are.
PLAIN = re.compile("[\t-\r -~¡-±´-¸º»¿-˿]*")
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
SPACE = "\t-\r \\x85\\xa0  -     　"
EXACT = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {(a, b): i for i, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.exact = regex.compile(EXACT)
        self.table = dict(enumerate(byte_symbols()))
        self.longest = max(map(len, self.vocab))
        self.stable: dict[str, int] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = pieces.Remembered(self._encode_pieces, REMEMBERED)
        most = max(self.tokens) + 1
        self.decimals = pa.array([b"%d " % i for i in range(most)], pa.large_binary())
        self.spaced = pa.array([self.tokens.get(i, "").encode() + b" " for i in range(most)], pa.large_binary())

    # words of a text

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if PLAIN.fullmatch(text):
            return FAST.findall(text.lower())
        return self.exact.findall(self.normalizer.normalize_str(text))

    # one pair of tokens

    def _edges(self, symbols: list[str]) -> tuple[list, list] | None:
        """How plain BPE builds one token of the symbols, or None if it ends with several.

        The result is the left and the right edge of the merge tree from leaf to
        root: each symbol that stands at that edge, with the rank of the merge
        that consumes it (none: the token itself).
        """
        rank, none = self.rank, len(self.rank)
        nodes = [(x, [[x, none]], [[x, none]]) for x in symbols]
        while len(nodes) > 1:
            ranks = [rank.get((nodes[i][0], nodes[i + 1][0]), none) for i in range(len(nodes) - 1)]
            best = min(ranks)
            if best == none:
                return None
            at = ranks.index(best)
            (x, left, _), (y, _, right) = nodes[at : at + 2]
            left[-1][1] = right[-1][1] = best
            nodes[at : at + 2] = [(x + y, [*left, [x + y, none]], [*right, [x + y, none]])]
        return nodes[0][1:]

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _own(self, token: str) -> int:
        """The token's id if it encodes to itself, else -1."""
        found = self.stable.get(token)
        if found is None:
            found, edges = -1, self._edges(self._symbols(token)) if token in self.vocab else None
            if edges is not None:
                found = self.vocab[token]
                self.edges[found] = edges
            self.stable[token] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' symbols gives back the two tokens.

        Both tokens grow by merges of rising rank. It fails if, while a symbol x
        ends the left part and y begins the right one, the pair x, y would be
        merged before either of them is consumed within its own token. Of equal
        ranks the merge further left comes first.
        """
        found = self.fits.get((left, right))
        if found is None:
            ends, begins, i, j = self.edges[left][1], self.edges[right][0], 0, 0
            none = len(self.rank)
            while True:
                (x, r), (y, s) = ends[i], begins[j]
                across = self.rank.get((x, y), none)
                if across < r and across <= s and across < none:
                    found = False
                    break
                if r == none and s == none:
                    found = True
                    break
                if r <= s:
                    i += 1
                else:
                    j += 1
            self.fits[left, right] = found
        return found

    # the trie

    def _last(self, word: str, depth: int, last: list[int], end: str) -> int:
        """Last token of ``word[:depth] + end``, from the last tokens of the shorter prefixes."""
        vocab, own, fits = self.vocab, self.stable, self.fits
        for size in range(min(depth, self.longest), 0, -1):
            piece = word[depth - size : depth] + end
            if piece not in vocab:
                continue
            token = own.get(piece)
            if token is None:
                token = self._own(piece)
            if token < 0:
                continue
            if size == depth:
                return token
            before = last[depth - size]
            fit = fits.get((before, token))
            if fit is None:
                fit = self._fit(before, token)
            if fit:
                return token
        raise ValueError(f"no token ends {word[:depth]!r}")

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """``(word, ids)`` of distinct words, by a depth-first walk of their trie.

        In sorted order words follow each other as a depth-first walk of their
        trie meets them; ``last`` is the path from the root, and what two words
        in a row share of it is kept.
        """
        mapped = sorted(("".join(map(self.table.__getitem__, w.encode("utf-8", "surrogatepass"))), w) for w in words)
        path, last, deep = "", [-1], 0
        for symbols, word in mapped:
            shared, most = 0, min(len(symbols) - 1, deep)
            while shared < most and path[shared] == symbols[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(symbols)):
                last.append(self._last(symbols, depth, last, ""))
            path, deep = symbols, len(symbols) - 1
            token = self._last(symbols, len(symbols), last, self.suffix)
            ids, at = [token], len(symbols) - (len(self.tokens[token]) - len(self.suffix))
            while at:
                token = last[at]
                ids.append(token)
                at -= len(self.tokens[token])
            ids.reverse()
            yield word, ids

    # whole texts

    def _encode_pieces(self, names: list[bytes]) -> list[list[int]]:
        """The ids of each of the distinct pieces."""
        if len(self.fits) > PAIRS:
            self.fits.clear()
        words = [self.words(n.decode()) for n in names]
        ids = dict(self.encode_words(sorted({w for own in words for w in own})))
        return [ids[own[0]] if len(own) == 1 else [t for w in own for t in ids[w]] for own in words]

    def _special(self, text: str) -> np.ndarray:
        """The ids of a text with special tokens, which keep their own."""
        out = []
        for i, part in enumerate(self.split_special.split(text)):  # type: ignore[union-attr]
            out.append(np.array([self.special[part]], np.uint32) if i % 2 else self.ids(pa.array([part], pa.string()))[0])
        return np.concatenate(out)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end of the last."""
        whole = texts.fill_null("")
        own: dict[int, np.ndarray] = {}
        if self.split_special is not None:
            odd = pc.match_substring_regex(whole, "|".join(map(re.escape, self.special)))
            if pc.any(odd).as_py():
                own = {i: self._special(whole[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
                whole = pc.if_else(odd, "", whole)
        ids, at = self.known.of(*pieces.bare_words(*pieces.raw(whole)))
        if own:
            parts = [own.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, at

    def column(self, texts: pa.Array) -> tuple[list, list, np.ndarray]:
        """Decimal ids joined by spaces, the decoded text in UTF-8, and the number of tokens, of each text."""
        ids, at = self.ids(texts)
        which = pa.array(ids)
        return _joined(self.decimals, which, at), _joined(self.spaced, which, at), np.diff(at)

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in bytes(self.column(pa.array([text], pa.string()))[0][0]).split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the files name no decoder. Special tokens stay."""
        return " ".join(self.tokens[i] for i in ids)


def _joined(names: pa.Array, which: pa.Array, at: np.ndarray) -> list:
    """The names of each text's ids in a row, without the space behind the last."""
    if not len(which):
        return [b""] * (len(at) - 1)
    row = names.take(which)
    ends = np.frombuffer(row.buffers()[1], np.int64, len(row) + 1, row.offset * 8)[at]
    data = memoryview(row.buffers()[2])
    return [data[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encoder(path: str) -> WordBpe:
    return kept(f"word pieces {path}", lambda: WordBpe(path))


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` of every row, or the sha256 of both with ``digests_only``.

    ``tokenizer_path`` is a file that every machine has. A null text counts as
    empty and has no tokens; repeated rows give repeated rows; an empty table
    gives an empty result.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sha(rows: list) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in text_groups(batches, "text", 1 << 20):
            ids, decoded, counts = bpe.column(batch.column(1))
            if digests_only:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), sha(ids), sha(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                numbers = pa.array([[int(i) for i in bytes(x).split()] for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), numbers, pa.array([bytes(x).decode() for x in decoded], pa.string())], ["id", "n_tokens", "ids", "decoded"])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only else "id long, n_tokens long, ids array<int>, decoded string"
    return arrow_map(rows, run, schema)
