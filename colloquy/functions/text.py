"""Column functions on text."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.session import batch_function

EMPTY_SNIPPET = "—"
ELLIPSIS = "…"
OBJECT_REPLACEMENT = "￼"
# Curly quotes and what they fold to.
CURLY_SINGLE, CURLY_DOUBLE = "‘’‚‛", "“”„‟"
# Symbols of reactions.
REACTION_SYMBOLS = {"loved": "♥", "liked": "👍", "disliked": "👎", "laughed": "😂", "emphasized": "‼", "questioned": "❓", "sticker": "🏷"}


@batch_function("string")
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


@batch_function("string")
def _ascii_form(texts: pa.Array) -> pa.Array:
    """Letters without their marks, in ASCII; what has no such form goes."""
    return pc.replace_substring_regex(pc.utf8_normalize(texts, "NFKD"), r"[^\x00-\x7F]", "")


def to_nfc(text: Column) -> Column:
    """Unicode NFC; texts below U+0300, which NFC leaves alone, do not reach Python, others go there in batches."""
    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), _nfc(text)).otherwise(text)


def fold_quotes(text: Column) -> Column:
    return F.translate(text, CURLY_SINGLE + CURLY_DOUBLE, "'" * len(CURLY_SINGLE) + '"' * len(CURLY_DOUBLE))


def collapse_space(text: Column) -> Column:
    """Runs of white space, in the Unicode sense, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_text(text: Column, nfc: bool = True) -> Column:
    """The searchable form: NFC, straight quotes, no variation selectors, single spaces. Idempotent."""
    return collapse_space(F.regexp_replace(fold_quotes(to_nfc(text) if nfc else text), "[\\uFE00-\\uFE0F]", ""))


def strip_object_marks(text: Column) -> Column:
    return F.regexp_replace(text, OBJECT_REPLACEMENT, "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for none."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def snippet(text: Column, chars: int) -> Column:
    """The trimmed text, cut to ``chars`` with an ellipsis; a dash for none."""
    bare = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    cut = F.concat(F.regexp_replace(F.substring(bare, 1, chars), r"(?U)[\s\x1c-\x1f]+$", ""), F.lit(ELLIPSIS))
    return F.when(F.coalesce(bare, F.lit("")) == "", EMPTY_SNIPPET).when(F.length(bare) > chars, cut).otherwise(bare)


def preview(text: Column, chars: int = 300) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(ELLIPSIS))).otherwise(text)


def mime_kind(mime: Column) -> Column:
    out = F.lit("other")
    for kind in ("video", "audio", "image"):
        out = F.when(mime.startswith(kind + "/"), kind).otherwise(out)
    return F.when(mime == "application/pdf", "pdf").otherwise(out)


def reaction_symbol(kind: Column) -> Column:
    """``emoji:x`` shows as x, a known kind as its symbol, another as it is."""
    table = F.create_map(*[F.lit(v) for pair in REACTION_SYMBOLS.items() for v in pair])
    return F.when(kind.startswith("emoji:"), F.substring(kind, 7, 1 << 20)).otherwise(F.coalesce(table[kind], kind))


def words(text: Column) -> Column:
    """Lower-case letters-and-digits words, Unicode, underscores apart."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([^\W_]+)"), 1)


@cache
def unaccented() -> tuple[str, str]:
    """Characters that decompose into a base and marks, and their bases: a table made from Unicode's own rule."""
    pairs = []
    for code in range(0xC0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and not unicodedata.combining(parts[0]) and all(map(unicodedata.combining, parts[1:])):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def terms_of(text: str) -> list[str]:
    """The driver-side twin of ``tokenize``."""
    table = str.maketrans(*unaccented())
    bare = "".join(c for c in text.lower().translate(table) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", bare)


def tokenize(text: Column) -> Column:
    """Index terms: lower case, diacritics removed, split at whatever is neither letter nor digit. Stays in the JVM."""
    folded = F.regexp_replace(F.translate(F.lower(text), *unaccented()), r"\p{Mn}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), 1)).otherwise(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def slug(text: Column) -> Column:
    """ASCII letters and digits of the text, decomposed, joined by hyphens."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), _ascii_form(text)).otherwise(text)
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def contains_emoji(text: Column) -> Column:
    return text.rlike("[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in EMOJI_RANGES) + "]")


# Code points that send a query to the substring route.
EMOJI_RANGES = ((0x1F1E6, 0x1F1FF), (0x1F300, 0x1FAFF), (0x1F000, 0x1F0FF), (0x2600, 0x27BF), (0x2300, 0x23FF), (0x2B00, 0x2BFF), (0x2190, 0x21FF))


def normalize_handle(raw: Column, default_code: str = "1") -> tuple[Column, Column]:
    """``(kind, value)``: e-mail addresses in lower case, phone numbers with their country code.

    Phone numbers are told by their digits alone: 10 digits take the default
    country code, a leading + or 00 gives its own. Other values are ``unknown``.
    """
    bare = F.trim(raw)
    digits = F.regexp_replace(bare, r"[^0-9]", "")
    looks = bare.rlike(r"^\+?[0-9 ().\-/]{7,}$")
    phone = (
        F.when(bare.startswith("+") & F.length(digits).between(8, 15), F.concat(F.lit("+"), digits))
        .when(bare.startswith("00") & F.length(digits).between(10, 17), F.concat(F.lit("+"), F.substring(digits, 3, 20)))
        .when(F.length(digits) == 10, F.concat(F.lit("+" + default_code), digits))
        .when((F.length(digits) == 11) & digits.startswith(default_code), F.concat(F.lit("+"), digits))
    )
    kind = F.when(bare.contains("@"), "email").when(looks & phone.isNotNull(), "phone").otherwise("unknown")
    return kind, F.when(kind == "email", F.lower(bare)).when(kind == "phone", phone).otherwise(bare)


# chunks


# What separates paragraphs, and sentences.
PARAGRAPHS, SENTENCES = r"\n\s*\n", r"(?<=[.!?])\s+"


def chunks_of(text: str | None, target: int = 1500, overlap: int = 150) -> list[str]:
    """Pieces of about ``target`` estimated tokens that begin with up to ``overlap`` of the piece before.

    Paragraphs are the units, or sentences where there is one paragraph; units
    beyond the target are sliced. Units are packed in order; those at the end of
    a piece that together stay within the overlap begin the next.
    """
    def cost(s: str) -> int:
        return -(-len(s) // 4)

    whole = (text or "").strip()
    if not whole:
        return []
    units = [u for u in map(str.strip, re.split(PARAGRAPHS, whole)) if u]
    if len(units) < 2:
        units = [u for u in map(str.strip, re.split(SENTENCES, whole)) if u]
    size = 4 * target
    pieces = [u[i : i + size] for u in units for i in range(0, len(u), size)]
    out: list[str] = []
    first, held = 0, 0  # the open piece is pieces[first:i], of held tokens
    for i, unit in enumerate(pieces):
        if i > first and held + cost(unit) > target:
            out.append("\n\n".join(pieces[first:i]))
            held, start = 0, i
            while start > first and held + cost(pieces[start - 1]) <= overlap:
                start -= 1
                held += cost(pieces[start])
            first = start
        held += cost(unit)
    out.append("\n\n".join(pieces[first:]))
    return out


def chunk_text(text: Column, target: int = 1500, overlap: int = 150) -> Column:
    """``chunks_of`` as a column."""
    @batch_function("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([chunks_of(t, target, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)

