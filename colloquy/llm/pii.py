"""Personal data: detection, and keyed surrogates of the same type and format.

Kinds: e-mail addresses, phone numbers, IPv4 addresses, payment cards, IBANs,
social-security numbers, secrets (after a telling name, or bare hexadecimal
digests outside licence lines), and names of persons after a title.

A surrogate is a keyed permutation of all values of the same format: characters
keep their class (digit, lower- or upper-case vowel or consonant, letter of a
script) and separators stay, the check digit of a card and the check digits of
an IBAN stay as valid as they were. As a permutation is one-to-one, different
values of one format get different surrogates without any table, equal values
get equal ones in every document, and tasks need not talk to each other. First
names come from lists by gender and script; surnames are permuted by themselves,
whatever the title and first name, so a name and a later mention of it with
another title agree. Words of a name that a document has after a title are
replaced wherever else that document has them.

What a permutation cannot exclude is checked over the whole corpus: a surrogate
that is itself a value found in the corpus, or that two values share (lists of
first names are finite), is replaced by that of a further attempt, until nothing
collides; of a person only the first names change for it, and become several
where the list is used up. In a format so dense that hardly a value is free all
values keep the first permutation, which is one-to-one among them; there a
surrogate may be another's real value. Those exceptions are joined to the documents that hold them; documents
are not shuffled when there are none.

Defined cases: a null text stays null and has no entities; where entities
overlap the earlier start wins, then the longer; repeated rows are treated
alike; a text of any length is searched whole; other columns of any name are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import arrow_map, cut, packed, ship_package, text_groups, unpacked

#: A format is dense if the corpus holds more than one in so many of its values.
DENSE = 4
#: Attempts after which a first name's surrogate has one name more.
WIDER = 4
#: Digits of the least number that is a phone's.
PHONE_DIGITS = 8
#: Exceptions that are sent to every task; beyond it they are joined by document.
EXCEPTIONS_SENT = 10_000

# First names by script and gender.
FIRST_NAMES = {
    ("latin", "f"): "Alice Anna Beatrice Carla Clara Diana Elena Emma Eva Flora Greta Hanna Helen Ida Irene Jane Julia Karin Laura Lena Linda Lucia Maria Marta Nina Nora Olga Paula Rosa Sara Silvia Sofia Tina Ursula Vera".split(),
    ("latin", "m"): "Adam Albert Anton Bruno Carl Daniel David Edgar Emil Erik Felix Frank Georg Hugo Ivan Jack James Jonas Karl Leo Louis Lukas Mark Martin Max Oscar Otto Paul Peter Ralph Robert Simon Thomas Victor Walter".split(),
    ("latin", "u"): "Alex Andrea Ariel Casey Chris Dominique Eden Jamie Jordan Jules Kim Luca Morgan Nicola Noa Quinn Robin Sam Sasha Taylor".split(),
    ("cyrillic", "f"): "Алина Анна Вера Галина Дарья Елена Ирина Лариса Марина Нина Ольга Полина Светлана Татьяна".split(),
    ("cyrillic", "m"): "Андрей Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег Павел Роман Сергей".split(),
    ("cyrillic", "u"): "Саша Женя Валя Слава Шура Паша".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Χρήστος".split(),
    ("greek", "u"): "Αλέξης Δάφνη Φοίβη Ιώνας".split(),
}
# Titles that come before a name, and the gender that they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "M": "m", "Señor": "m", "Sr": "m", "Don": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "u", "Prof": "u", "Professor": "u",
}

_NAME = r"[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁΑ-ΩΆ-Ώ][a-zß-öø-ÿā-žа-яёα-ωά-ώ]+(?:-[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-яё]+)?"
EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![\w-])")
IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\w)")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
CARD = re.compile(r"(?<![\w.+-])[0-9](?:[ \n-]?[0-9]){12,18}(?![\w-])")
PHONE = re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .\n-]?)?\(?[0-9]{3}\)?[ .\n-]{1,2}[0-9]{3}[ .\n-][0-9]{4}(?!\w)|(?<![\w.-])\+[0-9]{1,3}(?:[ .\n/()-]{1,2}[0-9]{1,8}){2,6}(?!\w)|(?<!\w)\+[0-9]{8,15}(?!\w)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|private[_-]?key|passw(?:or)?d|pwd|bearer|credential)s?[\"']?\s*(?:[:=]|=>|\s)\s*[\"']?([A-Za-z0-9_+/.~-]{8,}={0,2})")
DIGEST = re.compile(r"(?<![\w])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}(?![\w])")
PERSON = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(\.? )(" + _NAME + r"(?: " + _NAME + r"){0,2})(?!\w)")
WORD = re.compile(r"(?<!\w)" + _NAME + r"(?!\w)")
#: Quick tests for what every match holds: a digit; a word that could be a title before a capital letter.
DIGITS = "0123456789"
TITLED = re.compile(r"[MSDHFPГКΚ][a-zñéа-яά-ώ]{0,8}\.? [A-ZÀ-ÞĀ-ŽА-ЯЁΑ-ΩΆ-Ώ]")
KINDS = ("email", "iban", "card", "ssn", "ipv4", "phone", "secret", "person")


# detection


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the entities of a text, in order and apart from each other."""
    if not text:
        return []
    found: list[tuple[int, int, int, str]] = []

    def add(kind: str, start: int, end: int) -> None:
        found.append((start, -end, KINDS.index(kind), kind))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", *m.span())
    if any(c in text for c in DIGITS):
        for m in CARD.finditer(text):
            add("card", *m.span())
        for m in PHONE.finditer(text):
            if sum(c in DIGITS for c in m[0]) >= PHONE_DIGITS:
                add("phone", *m.span())
        if "." in text:
            for m in IPV4.finditer(text):
                add("ipv4", *m.span())
        if "-" in text:
            for m in SSN.finditer(text):
                add("ssn", *m.span())
        for m in IBAN.finditer(text):
            if _iban_rest(m[0].replace(" ", "")) == 1:
                add("iban", *m.span())
        for m in SECRET.finditer(text):
            value = m[1].rstrip(".")
            if any(c in value for c in DIGITS):
                add("secret", m.start(1), m.start(1) + len(value))
        for m in DIGEST.finditer(text):
            add("secret", *m.span())
    if TITLED.search(text):
        for m in PERSON.finditer(text):
            add("person", m.start(3), m.end(3))
    found.sort()
    out, end = [], 0
    for start, minus_end, _, kind in found:
        if start >= end:
            end = -minus_end
            out.append((start, end, kind))
    return out


def normal_form(kind: str, value: str, title: str = "") -> str:
    """What two mentions of one entity have in common; its format, separators aside, is kept."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn"):
        return re.sub("[^0-9]", "", value)
    if kind == "phone":
        return ("+" if value.startswith("+") else "") + re.sub("[^0-9]", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value


# keyed permutations


class Permutation:
    """A keyed permutation of 0 .. size - 1: a Feistel network, walked until it lands inside."""

    ROUNDS = 8

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.half = size, max(1, -(-(size - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{i}|{size}|{tweak}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=16).digest() for i in range(self.ROUNDS)]
        self.width = -(-self.half // 8)

    def _round(self, i: int, x: int) -> int:
        width = self.width
        if width <= 64:
            out = hashlib.blake2b(x.to_bytes(width, "big"), key=self.keys[i], digest_size=width).digest()
        else:
            out = hashlib.shake_256(self.keys[i] + x.to_bytes(width, "big")).digest(width)
        return int.from_bytes(out, "big") & self.mask

    def __call__(self, value: int) -> int:
        if self.size <= 1:
            return value
        while True:
            left, right = value >> self.half, value & self.mask
            for i in range(self.ROUNDS):
                left, right = right, left ^ self._round(i, right)
            value = left << self.half | right
            if value < self.size:
                return value


# Classes whose members stand in for each other.
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "àáâäèéêëìíîïòóôöùúûü", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ",
]
_CLASS_OF = {c: i for i, chars in enumerate(CLASSES) for c in chars}
_HEX = "0123456789abcdef"
_HEX_UP = _HEX.upper()


class Surrogates:
    """Surrogates of entities under one key."""

    def __init__(self, key: str | bytes):
        self.key = hashlib.sha256(key.encode() if isinstance(key, str) else key).digest()

    def permute(self, value: str, tweak: str, alphabet: str | None = None) -> str:
        """Another string of the same format: each character stays in its class, or in ``alphabet``."""
        sets = [alphabet if alphabet and c in alphabet else CLASSES[_CLASS_OF[c]] if c in _CLASS_OF else None for c in value]
        shape = "".join("." if s is not None else c for s, c in zip(sets, value, strict=True))
        number, size = 0, 1
        for c, s in zip(value, sets, strict=True):
            if s is not None:
                number, size = number * len(s) + s.index(c), size * len(s)
        kinds = ",".join(str(_CLASS_OF.get(s[0], "")) + str(len(s)) if s else "-" for s in sets)
        number = Permutation(self.key, f"{tweak}|{kinds}|{shape}", size)(number)
        out = []
        for c, s in zip(reversed(value), reversed(sets), strict=True):
            if s is None:
                out.append(c)
            else:
                number, at = divmod(number, len(s))
                out.append(s[at])
        return "".join(reversed(out))

    def space(self, kind: str, value: str) -> tuple[str, int]:
        """The format that a value shares with its surrogates, and how many values it has."""
        if kind in ("ipv4", "person"):
            return kind, 1 << 62
        keep = 0
        if kind == "phone":
            keep = self.kept(value)
        elif kind == "iban":
            keep = 4
        body = value[:-1] if kind == "card" else value.rpartition(".")[0] if kind == "email" else value[keep:]
        hexed = "" if kind != "secret" else _HEX if set(value) <= set(_HEX) else _HEX_UP if set(value) <= set(_HEX_UP) else ""
        shape, size = [], 1
        for c in body:
            n = len(hexed) or (len(CLASSES[_CLASS_OF[c]]) if c in _CLASS_OF else 1)
            size = min(size * n, 1 << 62)
            shape.append("h" if hexed else chr(0xE000 + _CLASS_OF[c]) if c in _CLASS_OF else c)
        rest = _luhn(value) if kind == "card" else value[len(body) :] if kind == "email" else value[:2] if kind == "iban" else value[:keep]
        return f"{kind}|{rest}|{''.join(shape)}", size

    @staticmethod
    def kept(phone: str) -> int:
        """The country code of a number with a single-digit code, or its first two digits, stay."""
        return 0 if not phone.startswith("+") else 2 if phone[1:2] in "17" else 3

    def first_name(self, name: str, gender: str, tweak: str) -> str:
        script = script_of(name)
        pool = FIRST_NAMES.get((script, gender)) or FIRST_NAMES[script, "u"]
        digest = hmac.new(self.key, f"first|{script}|{gender}|{name}|{tweak}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        return pool[int.from_bytes(digest[:8], "big") % len(pool)]

    def of(self, kind: str, value: str, attempt: int = 0, surname_attempt: int = 0) -> str:
        """The surrogate of a normal form; ``person`` values are ``gender|name``."""
        tweak = f"{kind}|{attempt}"
        if kind == "card":
            rest = _luhn(value)
            body = self.permute(value[:-1], f"{tweak}|{len(value)}|{rest}")
            return next(body + d for d in "0123456789" if _luhn(body + d) == rest)
        if kind == "ipv4":
            number = 0
            for octet in value.split("."):
                number = number * 256 + int(octet)
            number = Permutation(self.key, tweak, 1 << 32)(number)
            return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
        if kind == "iban":
            body = self.permute(value[4:], f"{tweak}|{value[:2]}", None)
            check = 98 - _iban_rest(value[:2] + "00" + body)
            return f"{value[:2]}{check:02d}{body}"
        if kind == "phone":
            keep = self.kept(value)
            return value[:keep] + self.permute(value[keep:], f"{tweak}|{value[:keep]}")
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.permute(local, tweak)}@{self.permute(host, tweak + '|host')}.{top}"
        if kind == "secret":
            if set(value) <= set(_HEX):
                return self.permute(value, tweak, _HEX)
            if set(value) <= set(_HEX_UP):
                return self.permute(value, tweak, _HEX_UP)
            return self.permute(value, tweak)
        if kind == "person":
            gender, _, name = value.partition("|")
            parts = name.split(" ")
            last = self.of("surname", parts[-1], surname_attempt)
            firsts = [self.first_name(p, gender, f"{attempt}|{i}" + (f"|{j}" if j else "")) for i, p in enumerate(parts[:-1]) for j in range(1 + attempt // WIDER)]
            return " ".join([*firsts, last])
        return self.permute(value, tweak)

    def rendered(self, kind: str, original: str, surrogate: str) -> str:
        """The surrogate with the original's separators and capitals."""
        if kind == "email":
            return "".join(s.upper() if o.isupper() else s for o, s in zip(original, surrogate, strict=True)) if len(original) == len(surrogate) else surrogate
        if kind in ("card", "ssn", "phone"):
            digits = iter(c for c in surrogate if c in DIGITS)
            return "".join(next(digits, "") if c in DIGITS else c for c in original)
        if kind == "iban" and " " in original:
            symbols = iter(surrogate)
            return "".join(c if c == " " else next(symbols, "") for c in original)
        return surrogate


def script_of(name: str) -> str:
    for c in name:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


_GENDER_OF = {n: g for (_, g), names in FIRST_NAMES.items() for n in names}


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, normal form)`` of each entity.

    A person's normal form begins with the gender: that of a listed first name,
    else that of a title the name has anywhere in the text, else ``u``.
    """
    out = []
    genders: dict[str, str] = {}
    for start, end, kind in detect(text):
        value = text[start:end]  # type: ignore[index]
        if kind == "person":
            title = text[:start].rstrip(" .").rsplit(None, 1)[-1].lstrip("(\"'«“„")  # type: ignore[index]
            first = value.split(" ")[0] if " " in value else ""
            gender = _GENDER_OF.get(first, "u")
            if gender == "u":
                gender = TITLES.get(title, "u")
            if genders.get(value, "u") == "u":
                genders[value] = gender
            out.append((start, end, kind, value))
        else:
            out.append((start, end, kind, normal_form(kind, value)))
    out = [(s, e, k, f"{genders[n]}|{n}" if k == "person" else n) for s, e, k, n in out]
    if genders:
        # Bare words of these names; the longest name with a word stands for it.
        whole: dict[str, str] = {}
        for name in sorted(genders, key=lambda n: (-n.count(" "), n)):
            for part in name.split(" "):
                whole.setdefault(part, f"{genders[name]}|{name}")
        at, bare = 0, []
        for m in WORD.finditer(text):  # type: ignore[arg-type]
            if m[0] in whole:
                while at < len(out) and out[at][1] <= m.start():
                    at += 1
                if at == len(out) or m.end() <= out[at][0]:
                    bare.append((*m.span(), "person", whole[m[0]]))
        out = sorted(out + bare)
    return out


def surname_of(kind: str, normal: str) -> str | None:
    return normal.rpartition("|")[2].rpartition(" ")[2] if kind == "person" else None


def replace(text: str | None, surrogates: Surrogates, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and ``(start, end, kind, surrogate)`` of what was replaced, places being those of the original."""
    found = entities(text)
    if not found:
        return text, []
    out, at, told = [], 0, []
    for start, end, kind, normal in found:
        surname = surname_of(kind, normal)
        new = surrogates.of(kind, normal, attempts.get((kind, normal), 0), attempts.get(("surname", surname), 0) if surname else 0)
        if kind == "person":
            own = normal.partition("|")[2].split(" ")
            if " ".join(own) != text[start:end]:  # type: ignore[index]
                names, each = new.split(" "), (new.count(" ") or 1) // max(1, len(own) - 1)
                i = own.index(text[start:end]) if text[start:end] != own[-1] else len(own) - 1  # type: ignore[index]
                new = " ".join(names[i * each : (i + 1) * each] if i < len(own) - 1 else names[-1:])
        else:
            new = surrogates.rendered(kind, text[start:end], new)  # type: ignore[index]
        out += [text[at:start], new]  # type: ignore[index]
        told.append((start, end, kind, new))
        at = end
    out.append(text[at:])  # type: ignore[index]
    return "".join(out), told


# the Spark side


def distinct_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(kind, normal)`` of every entity of the corpus, once."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text", 4 << 20):
            seen = {(k, n) for t in batch.column(0).to_pylist() for _, _, k, n in entities(t)}
            if seen:
                kinds, normals = zip(*sorted(seen), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(normals, pa.string())], ["kind", "normal"])

    return arrow_map(rows, run, "kind string, normal string").distinct()


def _visible(normal):
    """A normal form as it would stand in a text: a person's without the gender."""
    return F.when(F.col("kind") == "person", F.substring_index(normal, "|", -1)).otherwise(normal)


def resolve_collisions(found: DataFrame, key: str) -> DataFrame:
    """``(kind, normal, attempt)`` of those entities whose first surrogate will not do.

    Two different values may not share a surrogate, and a surrogate may not be a
    value that the corpus holds. Of values that share one the least keeps it.
    Surnames are resolved by themselves (kind ``surname``), then first names.
    """
    surname = F.element_at(F.split(_visible(F.col("normal")), " "), -1)
    surnames = found.where("kind = 'person'").select(F.lit("surname").alias("kind"), surname.alias("normal")).distinct()
    single = cut(_resolved(found.where("kind <> 'person'").unionByName(surnames).withColumn("base", F.lit(0)), key))
    base = single.where("kind = 'surname'").select(F.col("normal").alias("surname"), F.col("attempt").alias("base"))
    full = found.where("kind = 'person' and instr(normal, ' ') > 0").withColumn("surname", surname)
    full = full.join(base, "surname", "left").select("kind", "normal", F.coalesce("base", F.lit(0)).alias("base"))
    return single.unionByName(_resolved(full, key))


def _resolved(found: DataFrame, key: str) -> DataFrame:
    """The exceptions of rows ``(kind, normal, base)``; base is the attempt of a person's surname."""
    schema = "kind string, normal string, base int, attempt int, surrogate string"

    def with_surrogates(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maker = Surrogates(key)
            for batch in batches:
                kinds, normals, bases, attempts = (batch.column(i).to_pylist() for i in range(4))
                made = [maker.of(k, n, a, b) for k, n, b, a in zip(kinds, normals, bases, attempts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "normal", "base", "attempt", "surrogate"])

        return arrow_map(rows.select("kind", "normal", "base", "attempt"), run, schema)

    def spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key)
        for batch in batches:
            kinds, normals = (batch.column(i).to_pylist() for i in range(2))
            formats, sizes = zip(*[maker.space(k, n) for k, n in zip(kinds, normals, strict=True)], strict=True) if kinds else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(formats, pa.string()), pa.array(sizes, pa.int64())], ["kind", "normal", "base", "format", "size"])

    placed = cut(arrow_map(found.select("kind", "normal", "base"), spaces, "kind string, normal string, base int, format string, size long"))
    dense = placed.groupBy("format").agg(F.count("*").alias("n"), F.min("size").alias("size")).where(f"n > size / {DENSE}").select("format")
    found = placed.join(dense, "format", "left_anti")
    values = found.select("kind", _visible(F.col("normal")).alias("surrogate")).distinct()
    current = cut(with_surrogates(found.withColumn("attempt", F.lit(0))))
    # Ends, as three in four values of each format are free, and first names get longer.
    while True:
        keeper = current.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "normal")).alias("keeper"), F.count("*").alias("n"))
        shared = current.join(keeper.where("n > 1"), ["kind", "surrogate"]).where("keeper.normal <> normal").select("kind", "normal")
        real = current.join(values, ["kind", "surrogate"], "left_semi").select("kind", "normal")
        clash = cut(shared.unionByName(real).distinct())
        if clash.isEmpty():
            return current.where("attempt > 0").select("kind", "normal", "attempt")
        moved = with_surrogates(current.join(clash, ["kind", "normal"], "left_semi").withColumn("attempt", (F.col("attempt") + 1).cast("int")))
        current = cut(current.join(clash, ["kind", "normal"], "left_anti").unionByName(moved))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``text_col`` replaced, and the column ``pii_entities``.

    ``pii_entities`` lists start, end (in the original text), kind and surrogate
    of what was replaced; a column of that name is replaced.
    """
    ship_package(docs.sparkSession)
    exceptions = resolve_collisions(cut(distinct_entities(docs, text_col)), key)
    few = exceptions.limit(EXCEPTIONS_SENT + 1).collect()
    rest = docs.drop("pii_entities") if text_col != "pii_entities" else docs
    rows, _ = packed(rest, text_col)
    own = "map<string,int>"
    if len(few) > EXCEPTIONS_SENT:
        # By the hash of the text, which stands for it: rows of equal text need equal exceptions.
        rows = rows.withColumn("h", F.sha2("text", 256))

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_groups(batches, "text", 4 << 20):
                seen = sorted({(h, k, n) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, _, kind, normal in entities(t) for k, n in ((kind, normal), ("surname", surname_of(kind, normal))) if n})
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in range(3)], ["h", "kind", "normal"])

        held = arrow_map(rows.select("h", "text").where("text is not null"), mentions, "h string, kind string, normal string").distinct()
        by_text = held.join(exceptions, ["kind", "normal"]).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "normal"), "attempt"))).alias("own"))
        rows = rows.join(by_text, "h", "left").select("row", "text", "own")
        sent: dict[tuple[str, str], int] = {}
    else:
        rows = rows.withColumn("own", F.lit(None).cast(own))
        sent = {(r["kind"], r["normal"]): r["attempt"] for r in few}
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key)
        for batch in text_groups(batches, "text", 4 << 20):
            texts, told = [], []
            for text, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                attempts = sent
                if more:
                    attempts = {tuple(k.split("|", 1)): a for k, a in (more.items() if isinstance(more, dict) else more)}
                new, spans = replace(text, maker, attempts)
                texts.append(new)
                told.append([dict(zip(("start", "end", "kind", "surrogate"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(told, kind)], ["row", "text", "pii_entities"])

    entity = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("surrogate", T.StringType())])
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("pii_entities", T.ArrayType(entity))])
    return unpacked(arrow_map(rows, run, schema), rest, text_col, ["pii_entities"])
