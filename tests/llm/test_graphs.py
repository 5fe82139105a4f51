"""Vector and link graphs against brute force, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import entries, shingles, urlgraph, vectorgraph, winnow


def reachable(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def clustered(rnd, n):
    centres = [np.array([rnd.gauss(0, 1) for _ in range(16)]) for _ in range(12)]
    return [list(centres[i % 12] + 0.07 * np.array([rnd.gauss(0, 1) for _ in range(16)])) if i % 3 else [rnd.gauss(0, 1) for _ in range(16)] for i in range(n)]


@pytest.mark.parametrize("shard", [2048, 64])
def test_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(vectorgraph, "SHARD", shard)  # small: many shards, crowded clusters in parts
    vectors = clustered(random.Random(1), 500)
    vectors[7] = vectors[11]
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = reachable(500, list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 8), (1004, []), (None, vectors[0]), (1005, [None, *vectors[0][1:]])]
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(vectors)] + odd, "vec_id long, embedding array<double>").withColumn("rep", F.lit("x"))
    rows = vectorgraph.links_and_components(df).collect()
    got = {r["id"]: (r["n_links"], r["component"]) for r in rows}
    assert len(rows) == len(vectors) + len(odd)
    found, true = sum(got[i][0] for i in range(500)), int(near.sum())
    assert 0.97 * true <= found <= true and all(got[i][0] <= near[i].sum() for i in range(500))
    assert sum(got[i][1] == label[i] for i in range(500)) >= 485
    assert all(got[i] == (0, i) for i in (1000, 1001, 1002, 1003, 1004, 1005)) and got[None] == (0, None)


def test_vectors_are_exact_in_the_end(spark, monkeypatch):
    # An audit that is never content leads to one cluster, whose parts all meet.
    monkeypatch.setattr(vectorgraph, "SHARD", 64)
    monkeypatch.setattr(vectorgraph, "TARGET_RECALL", 2.0)
    monkeypatch.setattr(vectorgraph, "OVERLAP_MOST", 2)
    vectors = clustered(random.Random(2), 300)
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = reachable(300, list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component"]) for r in vectorgraph.links_and_components(df).collect()}
    assert got == {i: (int(near[i].sum()), label[i]) for i in range(300)}


def test_links_come_from_the_graph():
    """The search finds what a comparison of all finds, and nothing once the lists are empty."""
    x = np.array(clustered(random.Random(9), 400))
    unit = vectorgraph.unit(x)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    lists, ones = vectorgraph.build_graph(unit.astype(np.float32)), np.ones(400, np.int64)
    counts, _ = vectorgraph.shard_links(x, lists, ones, [[0]] * 400, 0, 0.95)
    assert near.sum() > 1000 and counts.sum() >= 0.99 * near.sum() and (counts <= near.sum(axis=1)).all()
    counts, label = vectorgraph.shard_links(x, [np.zeros(0, np.int64)] * 400, ones, [[0]] * 400, 0, 0.95)
    start = vectorgraph.medoid(unit.astype(np.float32))  # where every search begins
    assert np.delete(near, start, axis=0)[:, np.arange(400) != start].any() and counts.sum() == 2 * near[start].sum()


def test_audit_is_a_mean_over_queries(spark):
    # One group of many links that are all found does not hide pairs that are lost.
    rnd = np.random.default_rng(3)
    crowd, pairs = rnd.normal(size=(1, 16)) + 0.001 * rnd.normal(size=(60, 16)), np.repeat(rnd.normal(size=(20, 16)), 2, axis=0) + 0.001 * rnd.normal(size=(40, 16))
    x = np.concatenate([crowd, pairs])
    classes = spark.createDataFrame([(i, v.astype("<f8").tobytes(), 1) for i, v in enumerate(x)], "rep long, vec binary, m long")
    nodes = spark.createDataFrame([(i, v.astype("<f8").tobytes(), 59 if i < 60 else 0) for i, v in enumerate(x)], "rep long, vec binary, n_links long")
    assert vectorgraph.recall(nodes, classes, 0.95) == pytest.approx(0.6)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectorgraph.links_and_components(empty).count() == 0


def test_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(40, [2.0, -1.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = vectorgraph.links_and_components(df).collect()
    assert sorted((r["n_links"], r["component"]) for r in got) == [(0, 40)] + [(40, 0)] * 41


def test_graph_reaches_all():
    x = vectorgraph.unit(np.random.default_rng(0).normal(size=(700, 24))).astype(np.float32)
    lists = vectorgraph.build_graph(x)
    assert vectorgraph.reached(lists, vectorgraph.medoid(x), len(x)).all()


# urls


def brute_urls(pages, rules):
    out = {}
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:end].translate({k: k + 32 for k in range(65, 91)})
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(r), r, k) for k, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        out[i] = (host, path, *(max(fits)[1:] if fits else (None, None)))
    return out


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Net", "http://a.net/", "https://x.example.NET/en/1?q=/de/#f", "http://example.com/de/x", "http://notexample.com/de/x", "http://b.org/fr", "http://b.org/fr/", "http://b.org?x/fr/", "ftp://c.org#/fr/", "http://a.net://b/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlgraph.filter_urls(pages, entries.URL_RULES).collect()}
    for i, (host, path, rule, verdict) in brute_urls(enumerate(urls), entries.URL_RULES).items():
        assert got[i][:3] == (host, path, rule) and (verdict is None or got[i][3] == verdict)
    assert urlgraph.filter_urls(pages.limit(0), entries.URL_RULES).count() == 0
    twice = urlgraph.filter_urls(pages.unionByName(pages), entries.URL_RULES).select("id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, twice)) == sorted(2 * [repr(r) for r in urlgraph.filter_urls(pages, entries.URL_RULES).select("id", "host", "path", "rule", "verdict").collect()])


def spread_links(*hosts):
    return "".join(f'<a class="x" HREF="//{h}/p">l</a>' for h in hosts)


def brute_spread(out, good, bad):
    """Trust and distrust of each host from ``{host: {host: share}}``."""
    hosts, d = list(good), urlgraph.DAMPING
    mass, whole, value = dict(good), dict.fromkeys(hosts, 1.0), dict(bad)
    for _ in range(urlgraph.ROUNDS):
        new = {h: (1 - d) * good[h] + d * (0 if h in out else mass[h]) for h in hosts}
        all_ = {h: (1 - d) + d * (0 if h in out else whole[h]) for h in hosts}
        for src, to in out.items():
            for dst, share in to.items():
                new[dst] += d * mass[src] * share
                all_[dst] += d * whole[src] * share
        value = {h: bad[h] + (1 - bad[h]) * d * sum(s * value[x] for x, s in out.get(h, {}).items()) for h in hosts}
        mass, whole = new, all_
    return {h: mass[h] / whole[h] for h in hosts}, value


def test_spread(spark):
    rows = [(1, "http://good.org/fr/", spread_links("friend.info", "friend.info", "other.info")), (2, "http://bad.net/", ""), (3, "http://farm.info/", spread_links("bad.net", "BAD.net", "farm.info")), (4, "http://friend.info/", ""), (5, "http://alone.info/", "<a href=/local>"), (6, "http://other.info/", spread_links("good.org"))]
    got = {r["id"]: r for r in urlgraph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), entries.URL_RULES).collect()}
    assert got[3]["verdict"] == "block" and {got[i]["verdict"] for i in (4, 5, 6)} == {"allow"} and got[4]["trust"] > got[3]["trust"] == 0
    hosts = ["good.org", "bad.net", "farm.info", "friend.info", "other.info", "alone.info"]
    out = {"good.org": {"friend.info": 2 / 3, "other.info": 1 / 3}, "farm.info": {"bad.net": 1.0}, "other.info": {"good.org": 1.0}}
    trust, distrust = brute_spread(out, {h: float(h == "good.org") for h in hosts}, {h: float(h == "bad.net") for h in hosts})
    assert {r["host"]: (pytest.approx(r["trust"]), pytest.approx(r["distrust"])) for r in got.values()} == {h: (trust[h], distrust[h]) for h in hosts}


def test_spread_does_not_depend_on_size(spark):
    # Farms of any number of hosts, chains to a blocked host, a host of mostly blocked pages with links to it, and hosts with few bad links.
    rows = [("bad.net", "/", "")] + [(f"farm{i}.info", "/", spread_links("bad.net")) for i in range(12)] + [("chain.info", "/", spread_links("farm0.info"))]
    rows += [("half.info", "/", spread_links("bad.net", "fine.info")), ("news.info", "/", spread_links("bad.net", *["fine.info"] * 9)), ("fine.info", "/", "<!-- " + spread_links("bad.net") + " --><script>x = '" + spread_links("bad.net").replace("'", "") + "'</script>")]
    rows += [("example.com", "/de/", "")] * 9 + [("example.com", "/", "")] + [(f"fan{i}.info", "/", spread_links("example.com", "fine.info", "fine.info")) for i in range(5)]
    pages = spark.createDataFrame([(i, f"http://{h}{p}", html) for i, (h, p, html) in enumerate(rows)], "page_id long, url string, html string")
    got = {(r["host"], r["path"]): r["verdict"] for r in urlgraph.filter_urls(pages, entries.URL_RULES).collect()}
    blocked = {h for (h, p), v in got.items() if v == "block"}
    assert blocked == {"bad.net", "chain.info", "example.com", *(f"farm{i}.info" for i in range(12))} and got["example.com", "/"] == "block"


def test_url_sql_with_links(spark):
    import duckdb
    import pyarrow as pa

    rnd = random.Random(3)
    hosts = [f"h{i}.info" for i in range(20)] + ["bad.net", "worse.net", "good.org"]
    rows = [(i, f"https://{h}/{'fr/' if rnd.random() < 0.5 else ''}x", "<!--" + spread_links("bad.net") + "-->" * (i % 2) + "<p>" + spread_links(*rnd.choices(hosts, k=rnd.randrange(5)))) for i, h in enumerate(rnd.choices(hosts, k=200))]
    got = urlgraph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), entries.URL_RULES)
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    want = con.execute(entries.op2_sql()).fetchall()
    assert sorted(map(tuple, got.select("id", "host", "path", "rule", "verdict").collect())) == sorted(want)
    assert {"block", "allow"} == {r[4] for r in want if r[3] is None}


# pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    step, survivors = docs, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns, name
        step = spark.createDataFrame(step.collect(), docs.schema)
        survivors = {r["doc_id"] for r in step.collect()}
    assert out == survivors and len(out) > 0.7 * docs.count()
    hit = {r["id"] for r in winnow.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(spans) > 0").collect()}
    assert not out & hit
    groups = {r["id"]: r["component"] for r in shingles.near_copies(docs).collect()}
    kept = [groups[i] for i in out]
    assert len(kept) == len(set(kept))


def test_pipeline_odd(spark, odd_docs, sf):
    docs = odd_docs.withColumn("source", F.lit("s"))
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] for r in once.collect()), key=repr) == [1, 2, 5, 6, 7, None]
    named = corpus_pipeline.identify_language(spark, docs, "")
    assert named.columns == docs.columns and not {2, 3, 4, 7} & {r["doc_id"] for r in named.collect()}
    clean = corpus_pipeline.drop_benchmark_passages(spark, docs, sf)
    assert clean.columns == docs.columns and sorted(map(repr, clean.collect())) == sorted(map(repr, docs.collect()))
    private = corpus_pipeline.replace_personal_data(spark, docs, sf)
    assert private.columns == docs.columns and sorted(map(repr, private.drop("n_chars").collect())) == sorted(map(repr, docs.drop("n_chars").collect()))
    assert corpus_pipeline.encode_tokens(spark, docs, sf).count() == docs.count()
    empty = docs.limit(0)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_benchmark_in_blocks(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = {r["id"] for r in winnow.decontaminate(docs, items).where("size(spans) > 0").collect()}
    for size in (winnow.BLOCK_BYTES, 4000):
        left = winnow.without_hits(docs, items, block_bytes=size)
        assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()} - hit and left.columns == docs.columns
