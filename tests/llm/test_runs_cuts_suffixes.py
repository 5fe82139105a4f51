"""Periodic runs, fill-in-middle and suffix dedup against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import entries, fim, periods, suffixes

SPACES = "[^\x20\x09-\x0d]+"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# periodic runs


def brute_runs(w):
    """Every maximal stretch of every period, kept if no smaller period explains it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and all(any(w[s + j] != w[s + j + k] for j in range(length - k)) for k in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out)


def odd_texts():
    rnd = random.Random(1)
    texts = []
    for _ in range(250):
        alphabet = rnd.choice([1, 2, 3, 5, 30])
        w = [f"w{rnd.randrange(alphabet)}" for _ in range(rnd.choice([0, 1, 5, 6, 7, 20, 60, 150]))]
        if rnd.random() < 0.5 and w:
            unit = w[: rnd.randrange(1, len(w) + 1)]
            w = (w[:3] + unit * rnd.randrange(2, 9) + w[-2:])[:300]
        texts.append(rnd.choice([" ", "\n", "  \t"]).join(w) + rnd.choice(["", " "]))
    # Words that are frequent in their text, and a run whose multiples of its period are not scanned.
    return [*texts, None, "", "   ", "ä ö ä ö ä ö ä ö", "\x0b", " ".join(rnd.choice("ab") for _ in range(900)), " ".join(["a"] * 400 + ["b"] + ["a"] * 300), " ".join(["a", "b", "a", "c"] * 200)]


def test_runs():
    texts = odd_texts()
    _, begins, runs, kept = periods.runs_of_texts(pa.array(texts))
    for i, t in enumerate(texts):
        w = re.findall(SPACES, t or "")
        assert begins[i + 1] - begins[i] == len(w)
        assert runs[i] == brute_runs(w)
        gone = {j for s, n, q in runs[i] for j in range(s + q, s + n)}
        assert kept[begins[i] : begins[i + 1]].tolist() == [j not in gone for j in range(len(w))]
    assert periods.runs_of_texts(pa.array(["a " * 200_000]))[2] == [[(0, 200_000, 1)]]


def test_lag_counts_by_both_ways():
    rnd = np.random.default_rng(3)
    words = np.concatenate([rnd.integers(0, 4, 700), rnd.integers(0, 300, 500)])
    begins = np.array([0, 700, 700, 1200])
    counts, base = periods.lag_counts(words, begins)
    for d in range(3):
        w = words[begins[d] : begins[d + 1]]
        assert counts[base[d] : base[d + 1]].tolist() == [0] + [int((w[:-q] == w[q:]).sum()) for q in range(1, len(w) // 4 + 1)]


def brute_op11(doc_id, text):
    w = re.findall(SPACES, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {j for s, m, q in runs for j in range(s + q, s + m)}
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def test_op11(spark, tmp_path, odd_docs):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["the", "of", f"x{rnd.randrange(60)}"]) for _ in range(rnd.randrange(120)))) for i in range(300)]
    rows += [(300 + i, t) for i, t in enumerate(odd_texts()[::5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in entries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {i: brute_op11(i, t) for i, t in rows}
    assert sum(x[0] > 0 for x in got.values()) > 30
    done = periods.periodic_runs(odd_docs)
    assert done.count() == odd_docs.count() and done.where("size(runs) > 0").select("id", "n_words").collect() == [(5, 60_000)]
    assert periods.periodic_runs(odd_docs.limit(0)).count() == 0


# fill-in-middle


def brute_op12(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, len(p), len(m), sha(out), sha(text)


def test_op12(spark, tmp_path, odd_docs):
    rnd = random.Random(2)
    signs = ["ab", "\n", "ä", "日本", "😀", "<", "P>", "<P", ">", "\r\n", " "]
    rows = [(i, "".join(rnd.choice(signs) for _ in range(rnd.randrange(14)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "x"), (1004, "a<M>b\nc"), (1005, "a<"), (1006, ">"), (None, "one\ntwo\nthree"), (1007, "line\n" * 50_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in entries.op12_fill_in_middle(spark, str(tmp_path)).collect()}
    assert got == {i: brute_op12(i, t) for i, t in rows}
    assert {x[1] for x in got.values()} == {"plain", "spm", "psm"}
    back = fim.fill_in_middle(odd_docs, fim_percent=50).select("id", fim.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(back.collect(), key=repr) == sorted(odd_docs.select("doc_id", F.coalesce("text", F.lit(""))).collect(), key=repr)
    assert fim.fill_in_middle(odd_docs.limit(0)).count() == 0


# suffix dedup


def brute_suffixes(rows, k):
    best, out = {}, []
    known = [(i, (t or "").encode()) for i, t in rows]
    for i, b in known:
        for p in range(len(b) - k + 1 if i is not None else 0):
            best[b[p : p + k]] = min(i, best.get(b[p : p + k], i))
    for i, b in known:
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1 if i is not None else 0):
            if best[b[p : p + k]] < i:
                gone[p : p + k] = b"\1" * k
        spans = sum(1 for j, x in enumerate(gone) if x and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return sorted(out, key=repr)


def suffix_rows(k):
    rnd = random.Random(k)
    rows = []
    phrases = ["".join(rnd.choice("abcd ä\n") for _ in range(rnd.randrange(k, 5 * k))) for _ in range(8)]
    for d in range(120):
        t = "".join(rnd.choice([rnd.choice(phrases)[rnd.randrange(5) :], "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(2 * k)))]) for _ in range(rnd.randrange(6)))
        rows.append((rnd.choice([d, d, d, 5, None]), rnd.choice([t, t, t, None, ""])))
    return [*rows, (200, "a" * 1000), (201, "a" * 700 + "b"), (202, "ab" * 400), (7, rows[3][1]), rows[3], rows[3], (-4, rows[10][1]), (301, rows[10][1])]


@pytest.mark.parametrize(("k", "more"), [(50, {}), (8, {}), (3, {}), (50, {"crowd": 2}), (13, {"crowd": 3, "crowds": 2})])
def test_suffixes(spark, k, more):
    """Crowded hashes, and more of them than are broadcast, give the same as few."""
    rows = suffix_rows(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(docs, k=k, **more).selectExpr("id", "n_bytes", "n_removed", "size(spans)", "sha2(kept, 256)")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_suffixes(rows, k)


def test_op13(spark, sf, odd_docs):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = entries.op13_suffix_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_suffixes(docs, 50)
    done = suffixes.remove_repeats(odd_docs)
    assert done.count() == odd_docs.count() and done.where("n_removed > 0").count() == 0
    assert suffixes.remove_repeats(odd_docs.limit(0)).count() == 0


def test_suffix_order():
    """Classes of equal prefixes come in the order of their bytes."""
    rnd = random.Random(9)
    flat = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(400)), np.uint8)
    for k in (1, 5, 8, 9, 20, 50):
        at = np.arange(400 - k + 1)
        order, fresh = suffixes.suffix_classes(flat, at, k)
        strings = [flat[i : i + k].tobytes() for i in order]
        assert strings == sorted(strings)
        assert fresh.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def test_texts_and_answers_are_sent_small():
    """A hash goes out by its upper half, texts go packed, and both come together again."""
    w = np.array([1 << 40, 7, 2**63 + 5], np.uint64)
    told = [b for b in suffixes._told(np.array([3, 5, 3]), suffixes._short(w), 1)]
    assert [len(r["w"]) for b in told for r in b.to_pylist()] == [3 * 4]
    texts = {3: "the same words again " * 400, 4: "nobody asked", 5: "ä" * 90}
    rows = pa.RecordBatch.from_pydict({"id": list(texts), "text": list(texts.values()), "h": [30, 40, 50]})
    sent = list(suffixes._send_texts(iter([rows]), 1))
    assert sum(len(r["x"]) for b in sent for r in b.to_pylist()) < sum(map(len, texts.values())) / 10
    first = pa.RecordBatch.from_pylist([{n: r.get(n) for n in suffixes.TEXTS.names} for b in told for r in b.to_pylist()], suffixes.TEXTS)
    got = {}
    for ids, h, data, bounds, row, half in suffixes._told_texts(iter([first, *sent]), 100):
        for i, x in enumerate(ids.tolist()):
            got[x] = (int(h[i]), data[bounds[i] : bounds[i + 1]].tobytes().decode(), sorted(half[row == i].tolist()))
    assert got == {3: (30, texts[3], [1 << 8, 1 << 31]), 5: (50, texts[5], [0])}


def test_covered_spans_are_dealt_evenly_and_not_held():
    """What is covered already is united, goes to all buckets alike, and passes on without being held by bucket."""
    rnd = random.Random(4)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(400)) for _ in range(60)]
    sent = []
    for p, text in enumerate(passages):
        data = np.frombuffer((text * 2).encode(), np.uint8)
        least = suffixes.least_hashes(data)
        told = np.unique(suffixes._short(least))
        ids = np.array([2 * p, 2 * p + 1])
        row = (ids, np.array([7, 8], "<u4"), np.full(2, len(text)), np.tile(told, (2, 1)))
        texts = pa.RecordBatch.from_pydict({"id": ids, "text": [text] * 2, "h": row[1].astype(np.int64)})
        answers = [b for b in suffixes._told(np.repeat(ids, len(told)), np.tile(told, 2), 1)]
        first = pa.RecordBatch.from_pylist([{n: r.get(n) for n in suffixes.TEXTS.names} for b in answers for r in b.to_pylist()], suffixes.TEXTS)
        sent += [r for b in suffixes._send_stretches(iter([first, *suffixes._send_texts(iter([texts]), 1)]), 50, 24, 64, np.zeros(0, np.uint64)) for r in b.to_pylist()]
    covered = [r for r in sent if not r["raw"]]
    assert len(covered) == 60 and all(len(r["h"]) == 4 for r in covered)
    assert len({r["bucket"] for r in covered}) > 25
    passed = pa.RecordBatch.from_pylist(covered, suffixes.STRETCHES)
    got = {}
    for batch in suffixes._find(iter([passed]), 50, 1):
        for r in batch.to_pylist():
            for i, a, n in zip(*(suffixes._unplaned(r[c]).tolist() for c in ("ids", "start", "size")), strict=True):
                got[i] = (a, n)
    assert got == {2 * p + 1: (0, 400) for p in range(60)}


def test_suffixes_by_slices(spark, monkeypatch):
    """A bucket that is held in parts and compared in slices gives the same as one that is held whole, and no comparison sees more than its slice."""
    rows = suffix_rows(8)
    sent = []
    rnd = random.Random(6)
    strings = [bytes(2 * (i % 40) + rnd.randrange(2) for _ in range(12)) for i in range(4000)]  # a hash has its own letters
    for a in range(0, 4000, 500):
        part = strings[a : a + 500]
        key = suffixes._scrambled(np.array([1 + s[0] // 2 for s in part], np.uint64))
        sent.append({"bucket": 0, "key": suffixes._short(key).tobytes(), "ids": suffixes._planes(np.arange(a, a + 500)), "h": np.ones(500, "<u4").tobytes(), "at": suffixes._planes(np.zeros(500, np.int64)), "size": np.full(500, 12, "<u4").tobytes(), "x": pa.compress(b"".join(part), "zstd", asbytes=True), "raw": 6000})
    seen = []
    compare = suffixes._spans_of_slice
    monkeypatch.setattr(suffixes, "_spans_of_slice", lambda *x: seen.append(len(x[5])) or compare(*x))

    def spans():
        seen.clear()
        batch = pa.RecordBatch.from_pylist(sent, suffixes.STRETCHES)
        out = [r for b in suffixes._find(iter([batch]), 8, 3) for r in b.to_pylist()]
        return sorted((i, a, n) for r in out for i, a, n in zip(*(suffixes._unplaned(r[c]).tolist() for c in ("ids", "start", "size")), strict=True))

    whole = spans()
    assert whole and len(seen) == 1
    monkeypatch.setattr(suffixes, "BUCKET_HELD", 16_000)
    monkeypatch.setattr(suffixes, "COMPARED", 4_000)
    monkeypatch.setattr(suffixes, "SPANS_HELD", 100)
    assert spans() and max(seen) < 48_000 / 3
    by_id = {}
    for i, a, n in spans():
        by_id.setdefault(i, []).append((a, n))
    assert by_id == {i: [(a, n) for j, a, n in whole if j == i] for i in {j for j, _, _ in whole}}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffixes, "HASHES_HELD", 64)
    got = suffixes.remove_repeats(docs, k=8).selectExpr("id", "n_bytes", "n_removed", "size(spans)", "sha2(kept, 256)")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_suffixes(rows, 8)
