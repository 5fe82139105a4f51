"""The pipeline and its stages, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from colloquy.llm import langid, pii, shingles
from colloquy.llm.entries import PII_KEY


def brute_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = {i: brute_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_copies(spark, sf, monkeypatch):
    rnd = random.Random(5)
    make = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    texts = {}
    for _ in range(15):
        base, shared = make(rnd.choice([4, 30, 60, 200])), make(12)
        for _ in range(8):
            copy = [*base, *shared] if rnd.random() < 0.5 else list(base)
            for _ in range(rnd.randrange(6)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(99)}"
            texts[len(texts)] = " ".join(copy)
    want = brute_components(texts)
    docs = spark.createDataFrame([*texts.items(), (None, "a b c")], "doc_id long, text string")
    for slots, full, block in ((1 << 22, 128, 2048), (4, 1, 16)):
        monkeypatch.setattr(shingles, "SLOTS", slots)
        monkeypatch.setattr(shingles, "FULL", full)
        monkeypatch.setattr(shingles, "BLOCK", block)
        assert {r["id"]: r["component"] for r in shingles.near_copies(docs).collect()} == want
    assert shingles.near_copies(docs.limit(0)).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert {r["doc_id"] for r in kept} == {*want.values(), None}


def test_near_copies_of_a_crowd(spark, monkeypatch):
    # A large family of copies with more or fewer changes: many are similar to some, some to none.
    monkeypatch.setattr(shingles, "BLOCK", 64)
    monkeypatch.setattr(shingles, "FULL", 32)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(260):
        copy = list(base)
        for _ in range(rnd.randrange(9)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
        texts[i] = " ".join(copy)
    got = {r["id"]: r["component"] for r in shingles.near_copies(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got == brute_components(texts) and 1 < len(set(got.values())) < 200


def test_near_copies_of_the_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["id"]: r["component"] for r in shingles.near_copies(docs).collect()} == want


def test_contaminated_row_without_id(spark, sf):
    item = next(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").collect() if len(r["text"].split()) > 12)
    docs = spark.createDataFrame([(None, "so " + item), (None, "clean words"), (1, item), (2, "other words")], "doc_id long, text string")
    got = corpus_pipeline.drop_benchmark_passages(spark, docs, sf).collect()
    assert sorted(r["text"] for r in got) == ["clean words", "other words"]


# the whole pipeline


def brute_profile(text):
    """The sum of a text's trigram vectors, letter by letter; None without a letter."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return None
    marks = [0]
    for w in words:
        marks += [ord(c) + 1 for c in w] + [0]
    vector = langid.Letters.vector
    letters, out = langid._letters(), np.zeros(langid.DIMENSIONS)
    for (a, b, c), n in collections.Counter(zip(marks, marks[1:], marks[2:], strict=False)).items():
        out += float(n) * (np.roll(vector(letters, a), 2) * np.roll(vector(letters, b), 1) * vector(letters, c))
    return out / (len(marks) - 2)


def windows(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    size = min(10, len(words))
    return words, {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def test_the_whole_pipeline(spark, sf, word_bpe):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    profiles = {i: brute_profile(r["text"]) for i, r in docs.items()}
    sums = collections.defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for i, r in docs.items():
        if zlib.crc32(str(i).encode()) % 3 != 1 and r["lang"] is not None and profiles[i] is not None:
            sums[r["lang"]] += profiles[i]
    cosine = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    kept = {i for i, p in profiles.items() if p is not None and max(cosine(p, s) for s in sums.values()) >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    groups = brute_components({i: docs[i]["text"] for i in kept})
    kept = {i for i in kept if groups[i] == i}
    items = [windows(r["text"])[1] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    by_size = collections.defaultdict(set)
    for item in items:
        for w in item:
            by_size[len(w)].add(w)
    hit = {i for i in kept for words in [windows(docs[i]["text"])[0]] if any(tuple(words[a : a + n]) in grams for n, grams in by_size.items() for a in range(len(words) - n + 1))}
    exceptions = {(r["kind"], r["normal"]): r["attempt"] for r in pii.resolve_collisions(pii.distinct_entities(spark.createDataFrame([(docs[i]["text"],) for i in kept - hit], "text string")), PII_KEY).collect()}
    maker, library = pii.Surrogates(PII_KEY), Tokenizer.from_file(word_bpe)
    want = set()
    for i in kept - hit:
        ids = library.encode(pii.replace(docs[i]["text"], maker, exceptions)[0], add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
    assert len(hit) > 0 and len(want) < len(docs)
