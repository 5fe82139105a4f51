"""Operators on texts against brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import dac, entries, htmlrender, langid, pii, simhash, toxicity, trie_bpe, winnow
from colloquy.llm.common import shared_path
from colloquy.llm.components import connected_components

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert got == {n: c for n, c in least_reachable(nodes, links).items()}
    assert connected_components(df.limit(0)).count() == 0


# SimHash


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 10, 300, 900):
        text = " ".join(rnd.choice(["Ä", "Foo", "bar\n", "x y", "\t z", " "]) + str(rnd.random())[:4] for _ in range(n))
        assert simhash.fingerprint(text) == brute_simhash(text)


def test_fingerprint_is_sparks_hash(spark):
    word = spark.range(1).select(F.xxhash64(F.lit("one")).alias("h")).first()["h"]
    assert simhash.fingerprint("One") == word % 2**64


@pytest.mark.parametrize("full", [0, 3, 32])
@pytest.mark.parametrize("distance", [0, 1, 2])
def test_close_pairs(spark, distance, full):
    rnd = random.Random(distance)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(4))) for b in base for _ in range(12)}
    prints |= {base[0] ^ (1 << i) for i in range(64)}  # a crowd around one value
    prints |= {base[1] ^ rnd.getrandbits(6) for _ in range(50)} | {base[2] ^ rnd.getrandbits(6) << 40 for _ in range(50)}  # crowds in one segment
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "rep long, fp long")
    value = {i: p % 2**64 for i, p in rows}
    links = [(a, b) for a in value for b in value if a < b and (value[a] ^ value[b]).bit_count() <= distance]
    got = [(r["u"], r["v"]) for r in simhash.close_pairs(df, distance, full).collect()]
    assert all((value[a] ^ value[b]).bit_count() <= distance for a, b in got)
    assert least_reachable(value, got) == least_reachable(value, links)


def test_near_duplicates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: brute_simhash(t) for i, t in texts.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = least_reachable(prints, links)
    got = entries.op8_simhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_near_duplicates_odd(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r["id"]: r["component"] for r in rows}
    assert got[8] == 1 and got[2] == got[3] == got[4] == 2 and got[6] == 6
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


# winnowing


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    hit, met = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(ASCII_LOWER))
        if not own or name is None:
            continue
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                met.add(name)
    return len(words), len(hit), sorted(met)


@pytest.mark.parametrize("small", [False, True])
def test_winnowing(monkeypatch, small):
    if small:  # seams between pieces and chunks
        monkeypatch.setattr(winnow, "WORDS_AT_ONCE", 40)
        monkeypatch.setattr(winnow, "PAIRS_AT_ONCE", 7)
        monkeypatch.setattr(winnow, "PIECE", 37)
    rnd = random.Random(3)
    for _ in range(150):
        words = ["a", "B", "ç", "d1", "Éx", "f"][: rnd.choice([2, 3, 6])]
        make = lambda n: rnd.choice([" ", "-", ", "]).join(rnd.choice(words) for _ in range(n))
        items = [(str(i), make(rnd.choice([0, 1, 2, 5, 9, 10, 11, 12, 25]))) for i in range(6)]
        docs = [make(rnd.choice([0, 1, 5, 30, 100])) for _ in range(5)] + [make(5) + " " + items[i][1] + " " + make(3) for i in range(3)] + [None]
        for doc, (n, spans, names) in zip(docs, winnow.Index(items).documents(docs), strict=True):
            assert (n, sum(b - a for a, b in spans), names) == brute_hits(doc, items)


@pytest.mark.parametrize("block", [winnow.BLOCK_BYTES, 400])
def test_decontamination(spark, sf, odd_docs, block):
    bench = [("a", "one two three four five six seven eight nine ten eleven"), ("b", "Plain words of"), (None, "No id at all"), ("c", None), ("d", "!!"), ("b", "Plain words of")]
    items = spark.createDataFrame(bench, "item_id string, text string").withColumn("id", F.lit(1))
    docs = odd_docs.unionByName(spark.createDataFrame([(20, "x ONE two three four five six seven eight nine ten eleven plain words of y")], "doc_id long, text string"), allowMissingColumns=True)
    got = winnow.decontaminate(docs, items, block_bytes=block).select("id", "n_words", winnow.n_hit().alias("n_hit"), "items").collect()
    want = [(r["doc_id"], *brute_hits(r["text"], bench)) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert winnow.decontaminate(docs, items.limit(0)).where("size(items) > 0").count() == 0
    assert winnow.decontaminate(docs.limit(0), items).count() == 0


# BPE

PIECES = ["a", "b", "the", "ing", "É", "ß", "'s", " ", "  ", "\n", "\t", "1", "½", "²", "Σ", "σς", "ΑΣ", "İ", "́", "é", "中", "🙂", "_", "-", "!!", " ", "\u0085", "\x1c", "​", "<|startoftext|>", "<|endoftext|>", "<|", "　", "ª", "Ⅷ", "٣", "\x00", "\x7f", "ﬁ", "क्षि", "﻿", "don't", "WE'RE", " x"]


def test_trie_bpe(word_bpe):
    from tokenizers import Tokenizer

    library, own, rnd = Tokenizer.from_file(word_bpe), trie_bpe.encoder(word_bpe), random.Random(1)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(rnd.randint(1, 90))) for _ in range(1000)] + ["aaaa" * 300, ""]
    for text, ids, decoded, n in zip(texts, *own.column(pa.array(texts)), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int(x) for x in bytes(ids).split()] == want and bytes(decoded).decode() == library.decode(want, skip_special_tokens=False) and n == len(want)


def test_trie_bpe_rows(spark, odd_docs, word_bpe):
    rows = trie_bpe.encode_decode(odd_docs, word_bpe).collect()
    by_id = {r["id"]: r for r in rows}
    assert len(rows) == odd_docs.count() and by_id[2]["n_tokens"] == 0 == by_id[4]["n_tokens"] and by_id[5]["n_tokens"] == 60_000 and by_id[2]["ids"] == []
    assert trie_bpe.encode_decode(odd_docs.limit(0), word_bpe, digests_only=True).count() == 0


# token files


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("n", [1, 5, 511, 512, 513, 4000])
def test_codes(n):
    rnd = random.Random(n)
    ids = np.array([rnd.choice([0, 255, 256, 65535, 65536, 50256, 2**32 - 1, 7]) for _ in range(n)], dtype=np.uint32)
    reader = dac.DacReader(Bytes(dac.file_bytes([4, None], np.array([0, n // 2, n]), ids)))
    assert reader.documents()[0] == [4, None] and (reader.tokens(0, n) == ids).all()
    assert [reader.token(i) for i in range(0, n, 7)] == ids[::7].tolist()
    for _ in range(10):
        a = rnd.randint(0, n)
        b = rnd.randint(a, n)
        assert (reader.tokens(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        reader.token(n)


def test_piece_encoder(byte_bpe):
    from tokenizers import Tokenizer

    library, own, rnd = Tokenizer.from_file(byte_bpe), dac.encoder(byte_bpe), random.Random(4)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["", None, "a"]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in own.texts(texts, None)] == want
    # Texts alone, and with a memory that is emptied again and again.
    own.known.most = 5
    assert [own.texts([t])[0].tolist() for t in texts[:500]] == [x + [0] for x in want[:500]]


def test_token_files(spark, odd_docs, byte_bpe, monkeypatch):
    from tokenizers import Tokenizer

    library, folder = Tokenizer.from_file(byte_bpe), shared_path(spark, "tokens-test")
    files = dac.write_tokens(odd_docs, folder, byte_bpe)
    got = dac.read_digests(files).orderBy("start").collect()
    want = sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    nothing = dac.write_tokens(odd_docs.limit(0), folder, byte_bpe)
    assert nothing.count() == 0 and dac.read_digests(nothing).count() == 0


def test_token_files_of_a_task(spark, byte_bpe, monkeypatch, tmp_path):
    # Many files a task: starts run on over files and tasks.
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(id % 7 as int))").alias("text"))
    whole = {r["id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in dac.read_digests(dac.write_tokens(docs, str(tmp_path / "a"), byte_bpe)).collect()}
    total = 0
    for i in range(300):
        assert whole[i][0] == total
        total += whole[i][1]


# language


def test_language(spark, sf, odd_docs):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in entries.op9_language_id(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.95
    odd = {r["id"]: r for r in langid.identify_held_out(odd_docs).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["lang_score"] == 0 for i in (2, 3, 4, 7)) and odd[6]["lang_pred"] in ("de", "en")
    nothing = langid.identify_held_out(odd_docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"] and langid.identify_held_out(odd_docs.limit(0)).count() == 0


def test_label_and_source_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, prototypes = langid.learn(docs, F.lit(True))
    a = langid.identify(docs, names, prototypes).select("doc_id", "lang_pred")
    b = langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), names, prototypes).select("doc_id", "lang_pred")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_trigram_profile():
    columns, bounds, vectors = langid.trigrams(["abab", None, "Ab"])
    assert bounds.tolist() == [0, 4, 4, 6]
    a, b, gap = (langid._letters().vector(s) for s in (1 + 97, 1 + 98, 0))
    assert (vectors[columns[0]] == np.roll(gap, 2) * np.roll(a, 1) * b).all() and (vectors[columns[4]] == vectors[columns[0]]).all()


def test_every_letter_has_its_vector():
    # Letters far apart in Unicode do not share vectors: 4,093 lies between the two.
    texts = ["一丁七", chr(ord("一") + 4093) + chr(ord("丁") + 4093) + chr(ord("七") + 4093)]
    columns, bounds, vectors = langid.trigrams(texts)
    one, two = langid.bundles(columns, bounds, vectors)
    assert abs(one @ two) / (one @ one) < 0.5


def test_bundles_are_sums():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(60))) for _ in range(150)]
    columns, bounds, vectors = langid.trigrams(texts)
    want = np.array([vectors[columns[a:b]].sum(axis=0, dtype=np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    assert (langid.bundles(columns, bounds, vectors) == want).all()


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "plain words", "x", 2.0, "z")], "doc_id long, text string, `a b.c` string, row double, `q``r` string")
    langs = langid.identify(docs, ["en"], np.ones((1, langid.DIMENSIONS), np.float32))
    assert langs.columns == [*docs.columns, "lang_pred", "lang_score"] and tuple(langs.first())[:5] == tuple(docs.first())


# toxicity


def test_toxicity(spark, odd_docs):
    rnd = random.Random(8)
    clean = lambda: " ".join(rnd.choice("river stone garden window letter evening market".split()) for _ in range(40))
    rows = [(i, clean() + (" you stupid idiot, you are a worthless loser" if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (9999, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == 600 and all((r["predicted"] == 1) == (r["id"] % 5 == 0) for r in got)
    assert {r["id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(600)}
    none = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert len(none) == odd_docs.count() and all(r["score"] == 0.0 for r in none)
    assert len(toxicity.toxicity(odd_docs, labels).collect()) == odd_docs.count() and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_of_the_data(spark, sf):
    """Held-out rows of the real labels; some are marked toxic at random, so those count that have an insult."""
    folder = sf.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    insulting = lambda i: toxicity.features(texts[i])[toxicity.FEATURES.index("log_insults")] > 0
    rows = [r for r in entries.op3_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    bad, good = [r for r in rows if truth[r["doc_id"]] and insulting(r["doc_id"])], [r for r in rows if not truth[r["doc_id"]]]
    assert len(bad) > 5 and sum(r["predicted"] for r in bad) >= 0.9 * len(bad) and sum(r["predicted"] for r in good) <= 0.02 * len(good)


def test_toxicity_has_no_limits_of_length():
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    long = "word " * 900_000
    for end in ("i d i o t", "i-d-i-o-t", "i d i o t ."):
        assert toxicity.features(long + end)[at["log_disguised"]] == toxicity.features("word " + end)[at["log_disguised"]] >= np.log(2) - 1e-9
    assert toxicity.classify("id" + "i" * 400 + "ot") & toxicity.DISGUISED and toxicity.classify("a" * 50 + "0x1") & toxicity.MIXED
    assert toxicity.stems("x" * 3 + "y" * 60) == {"xxx" + "y" * 60, "xxxy", "xxxyy", "xxxyyy", "xxxyyyy"}
    assert toxicity.spelled_out("s t u p i d i d i o t") == 2 and toxicity.spelled_out("a b c d e f g") == 0


def test_disguises():
    for word in ("1d10t", "st*pid", "i.d.i.o.t", "stuuupid", "tr@sh", "pathet!c"):
        assert toxicity.classify(word) & toxicity.DISGUISED
    for word in ("market", "anna@x.com", "3.5", "well-known", "https://x.org/a1"):
        assert not toxicity.classify(word) & (toxicity.DISGUISED | toxicity.PLAIN)


def test_isotonic():
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(ys) >= 0).all() and np.interp(2.5, xs, ys) == 0.5 and np.interp(9, xs, ys) == 1.0


# personal data


@pytest.mark.parametrize("size", [1, 2, 3, 10, 257, 1000])
def test_permutation(size):
    assert sorted(map(pii.Permutation(b"k" * 16, "t", size), range(size))) == list(range(size))


def test_surrogates():
    text = 'Mail Bob.Smith@Mail3.example.com, call +1 (377) 555-0271, pay 4111 1111 1111 1111, from 10.4.5.6; token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f". Dr. Anna Müller met Mrs. Anna Müller; Herr Иван Петров; IBAN DE89 3704 0044 0532 0130 00; SSN 123-45-6789.'
    new, told = pii.replace(text, pii.Surrogates("k"), {})
    kinds = [k for _, _, k, _ in told]
    assert kinds == ["email", "phone", "card", "ipv4", "secret", "person", "person", "person", "iban", "ssn"]
    for start, end, kind, surrogate in told:
        old = text[start:end]
        assert surrogate != old and surrogate in new and old not in new
        if kind in ("email", "phone", "card", "secret", "iban", "ssn"):
            assert [c.isdigit() for c in old] == [c.isdigit() for c in surrogate] or kind == "secret"
            assert len(old) == len(surrogate)
    card = "".join(c for c in told[2][3] if c.isdigit())
    assert pii._luhn(card) == 0 and pii._iban_rest(told[8][3].replace(" ", "")) == 1
    assert told[5][3] == told[6][3] and told[5][3].split()[0] in pii.FIRST_NAMES["latin", "f"] and told[7][3].split()[0] in pii.FIRST_NAMES["cyrillic", "m"]
    assert pii.replace("nothing to see, 3.14 or 2024-01-01", pii.Surrogates("k"), {})[1] == []
    assert pii.replace(text, pii.Surrogates("other"), {})[0] != new


def test_distinctness():
    maker, rnd = pii.Surrogates("k"), random.Random(3)
    for kind, values in (("card", {f"{rnd.randrange(10**15):016d}" for _ in range(2000)}), ("email", {f"a{i}@b.com" for i in range(2000)}), ("ipv4", {f"1.2.{i // 200}.{i % 200}" for i in range(2000)})):
        assert len({maker.of(kind, v) for v in values}) == len(values)


@pytest.mark.parametrize("sent", [10_000, 0])
def test_collisions_are_resolved(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "EXCEPTIONS_SENT", sent)
    names = [f"{a} Li" for a in "Abel Bert Cora Dora Edna Fern Gale Hope Iris Joan Kay Lois May Nell Opal Pearl Queenie Ruth Stella Thea Una Viola Willa Xenia Yara Zelda Amos Bram Cyrus Dirk".split()]
    docs = spark.createDataFrame([(i, f"Ms. {n} was here, with Ms. {names[0]}", "r") for i, n in enumerate(names)] + [(99, None, "r")], "doc_id long, text string, own string")
    rows = pii.pseudonymise(docs, "k").collect()
    shown = {r["doc_id"]: [e["surrogate"] for e in r["pii_entities"]] for r in rows if r["text"]}
    first = {i: s[0] for i, s in shown.items()}
    assert len(set(first.values())) == len(names) and {s[1] for s in shown.values()} == {first[0]}
    assert next(r for r in rows if r["doc_id"] == 99)["text"] is None and all(r["own"] == "r" for r in rows)


@pytest.mark.parametrize("sent", [10_000, 0])
def test_surname_is_one_whatever_title_and_first_name(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "EXCEPTIONS_SENT", sent)
    names = "Abel Bert Carl Dirk Emil Fred Gus Hank Igor Jack Kurt Lars".split()
    rows = [(0, "Mr John Smith came. Mr Smith and Dr Smith sat; Smith said that John left."), (1, "Mrs Smith"), (2, "Smith unnamed")]
    docs = spark.createDataFrame(rows + [(10 + i, f"Mr {n} Smith") for i, n in enumerate(names)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    shown = [e["surrogate"] for e in got[0]["pii_entities"]]
    first, last = shown[0].split(" ")
    assert shown[1:] == [last, last, last, first] and "Smith" not in got[0]["text"] and "John" not in got[0]["text"]
    assert got[1]["text"] == f"Mrs {last}" and got[2]["text"] == "Smith unnamed"
    full = {got[10 + i]["text"] for i in range(len(names))}
    assert len(full) == len(names) and all(x.endswith(" " + last) for x in full)


def test_dense_formats(spark):
    vowels, consonants = "AEIOU", "bcdfghjklmnpqrstvwxyz"
    rows = [f"Mr {a}{b}" for a in vowels for b in consonants] + [f"Prof. Саша{c} Ли, Prof. {c}а Ли" for c in "бвгджзклмнпрст"]
    rows = [r.replace(" ба", " Ба") for r in rows] + [f"+1 {a} {b}" for a in range(10) for b in range(10)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    assert len({got[i]["text"] for i in range(105)}) == 105
    assert all(got[i]["text"] == rows[i] for i in range(len(rows) - 100, len(rows)))
    people = {e["surrogate"] for i in range(105, 119) for e in got[i]["pii_entities"][:1]}
    assert len(people) == 14


def test_pii_agrees_over_documents(spark):
    docs = spark.createDataFrame(
        [(1, "Mrs. Anna Keller met Mr. Tom Keller. Keller said so, Anna did not."), (2, "Dr. Keller wrote to Frau Anna Keller, anna@keller.example, +49 170 1234567."), (3, "Call +49 170 1234567 or anna@keller.example. Nothing else, Keller."), (4, None), (5, "")],
        "doc_id long, text string",
    ).withColumns({"a b": F.lit("x"), "c.d": F.struct(F.lit(1).alias("e f"))})
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    assert rows[4]["text"] is None and rows[5]["text"] == "" and rows[1]["a b"] == "x" and rows[1]["c.d"]["e f"] == 1
    names = lambda i: [e["surrogate"] for e in rows[i]["pii_entities"] if e["kind"] == "person"]
    last = {n.split(" ")[-1] for n in [*names(1)[:3], *names(2)]}
    assert len(last) == 1 and "Keller" not in rows[1]["text"] and names(1)[0] == names(2)[1] and names(1)[3] == names(1)[0].split(" ")[0]
    found = [{(e["kind"], e["surrogate"]) for e in rows[i]["pii_entities"] if e["kind"] in ("email", "phone")} for i in (2, 3)]
    assert found[0] == found[1] and len(found[0]) == 2 and rows[3]["text"].endswith("Nothing else, Keller.")


def test_pii_rows(spark, odd_docs):
    done = pii.pseudonymise(odd_docs, "k")
    assert done.columns == [*odd_docs.columns, "pii_entities"] and sorted(map(repr, done.drop("pii_entities").collect())) == sorted(map(repr, odd_docs.collect()))
    assert pii.pseudonymise(odd_docs.limit(0), "k").count() == 0


# pages


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, None), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"), ("a<br>b", "a\nb"), ("<b>x</b> y&amp;z", "x y&z"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3</table>", "Name   Qty\nApple  3"), ("<pre>  a\n   b</pre>", "  a\n   b"), ("<div hidden>n</div>y<script>var t='</p>'</script>", "y"),
        ("<style>.x{display:none}</style><i class='a x'>n</i>y", "y"), ("<details><summary>s</summary>n</details>", "s"), ("<title>t</title>y<!-- c -->", "y"), ("<td>lost", "lost"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "x", "deep\nx"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ],
)
def test_html(html, text):
    got = htmlrender.render(html)
    assert (got.replace("\n\n", "\n") == text) if html and "deep" in html else got == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<style>@media print { nav, .ads { display:none } }</style><nav>n</nav><i class=ads>a</i>", "n\na"), ("<style>@media (max-width:600px) { .d { display:none } } .e{display:none}</style><i class=d>d</i><i class=e>e</i>", "d"),
        ("<style>@media screen { .d { display:none } }</style><i class=d>d</i>y", "y"), ("<style>.d{display:none} .d{display:block}</style><i class=d>d</i>", "d"), ("<style>@charset 'x'; .d{display:none}</style><i class=d>d</i>y", "y"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"), ("<svg><title>no</title><desc>no</desc><g><text>label</text></g></svg>", "label"), ("<textarea>a\nb</textarea>", "a\nb"),
        ("<select><option>one<option>two</select>", "one\ntwo"), ("<map>m</map>", "m"),
    ],
)
def test_html_shows_all_that_is_visible(html, text):
    assert htmlrender.render(html) == text


def test_html_is_linear_and_keeps_what_is_hidden_hidden():
    import time

    for n in (2, 130, 20_000):  # the layout is the same at any depth
        deep = "<div>" * n + "<script>var x=1</script><style>.h{display:none}</style><div hidden>secret<b>more</b></div><p class=h>gone</p>seen<p>one<p>two" + "</div>" * n + "after"
        assert htmlrender.render(deep) == "seen\n\none\n\ntwo\n\nafter"
        assert htmlrender.render("<span>" * n + "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>") == "a    bb\nccc  d"
    assert htmlrender.render("<ul><li>" * 500 + "leaf").split("\n")[-1] == "  " * 499 + "- leaf" and htmlrender.render("<ul><li>" * 500 + "leaf", most_indent=10).split("\n")[-1] == " " * 8 + "- leaf"
    assert htmlrender.render("<table><tr><td>" * 200 + "cell") == "cell" and htmlrender.render("<pre>" + "<b>" * 9000 + " as\n it is") == " as\n it is"
    began = time.process_time()
    for page in ("<a " * 30_000, "<!--" * 30_000, "<b>" * 20_000 + "</i>" * 20_000, "<p>" * 20_000, "<div><b>" * 10_000 + "</div>" * 10_000, "<ul>" * 100 + "<li>x" * 5_000, "&" * 50_000, "<table>" * 3_000 + "x"):
        assert len(htmlrender.render(page)) < 20 * len(page)
    wide = "<table><tr><td>" + "x" * 50_000 + "<td>b" + "<tr><td>1<td>2" * 1000 + "</table>"
    out = htmlrender.render(wide, fill=8)  # columns whose blanks would outgrow their text may be left as they are
    assert len(out) < 2 * len(wide) and out.endswith("1  2") and time.process_time() - began < 20
    assert htmlrender.render(wide).split("\n")[-1] == "1" + " " * 50_001 + "2"
    assert htmlrender.render("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>") == "a    bb\nccc  d"


def visible_words(html):
    """The words of a page by the library's own tokenizer, without layout."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "head", "title", "template", "noscript")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "head", "title", "template", "noscript")

        def handle_data(self, data):
            if not self.hidden:
                self.out += data.split()

    parser = Words()
    parser.feed(html)
    parser.close()
    return parser.out


def test_html_loses_no_word_of_simple_pages():
    rnd = random.Random(6)

    def page(depth):
        tag = rnd.choice(["p", "div", "b", "ul", "span", "section", "blockquote", "em", "h2"])
        inner = " ".join(page(depth - 1) if depth and rnd.random() < 0.6 else f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 5)))
        inner = f"<li>{inner}</li>" if tag == "ul" else inner
        return rnd.choice([f"<{tag}>{inner}</{tag}>", f"<{tag.upper()} class='x y' data-a=\"1>2\">{inner}</{tag}>", f"<!-- <b>c</b> --><{tag}>{inner}</{tag}><script>var a = '<p>no</p>';</script>"])

    for _ in range(300):
        html = page(4)
        got = [w for w in htmlrender.render(html).split() if w != "-"]
        assert got == visible_words(html)


def test_html_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert htmlrender.extract(pages.withColumn("text", F.lit(1))).count() == pages.count() and htmlrender.extract(pages.limit(0)).count() == 0
