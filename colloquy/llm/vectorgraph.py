"""Embedding near-duplicates by range search on a robust-pruned flat graph.

Equal vectors are one node with a multiplicity. Nodes go to the shards of their
``overlap`` nearest cluster centres, so shards overlap; a cluster beyond
``SHARD`` nodes is dealt out into parts, and every two parts of it meet in a
shard of their own, so a shard's memory is bounded whatever the clusters are. In
each shard a graph is built: candidates are the nearest nodes and some random
ones, pruned by the robust rule (an edge is left out if one already taken leads
there), made symmetric, and mended until the medoid reaches every node. The
adjacency lists of all shards are united into one flat graph. Then every node is
a query in each of its shards: a greedy search runs from the medoid, over the
united lists, to the query's vicinity, and from there expands through all nodes
in range (with some slack) until no new one turns up. What it meets, from either
end of a pair, is verified by cosine in double precision. Nothing else adds
links: without the lists a search meets nothing.

A pair counts in the first shard that both ends share, so nothing needs to be
emitted pair by pair: a shard returns a count and a local component per node.
Centres are fitted on at most ``SAMPLE`` nodes, and ``SAMPLE_BYTES`` of them; every
node is indexed. What can be missed are pairs that share no shard, and pairs that
a search does not reach, so recall is audited at every overlap:
the mean, over ``AUDITED`` nodes drawn by a hash, of the share of a node's links
to other vectors that a comparison with all rows finds. Below the target the
search is repeated with twice the overlap, and beyond ``OVERLAP_MOST`` with one
cluster, whose parts all meet.

Clusters fit their shards up to ``CLUSTERS_MOST * SHARD / overlap`` nodes, about
eight million; with more of them parts meet more often, in proportion to the
size of a cluster. ``CLUSTERS_MOST`` and ``SAMPLE`` are to be raised together.

Defined cases: vectors that are null, of zero length or hold null or non-finite
components have no links and are their own component, as are rows without an id,
whose component is null; vectors of different dimension do not link; repeated
rows are links of each other; nodes at equal distances may change places in a
graph, but not in the result, as all in range are taken; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_map, cut, ship_package
from colloquy.llm.components import connected_components

SAMPLE, SAMPLE_BYTES, SHARD, CLUSTERS_MOST = 65_536, 128 << 20, 2048, 8192
DEGREE, NEAREST, RANDOM, ALPHA = 16, 32, 16, 1.2
BEAM, QUERIES_AT_ONCE, PAIRS_AT_ONCE, SLACK = 16, 256, 1 << 16, 0.05
AUDITED, TARGET_RECALL, OVERLAP_MOST = 1000, 0.97, 16
log = logging.getLogger(__name__)


# one shard


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; ``x`` has unit rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-9
        centres = np.where(empty[:, None], x[rng.choice(len(x), k)], sums / np.maximum(norms, 1e-9)[:, None])
    return centres


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each node, -1 where there are fewer: a candidate goes once one taken is ``alpha`` times nearer to it."""
    vectors = x[candidates]
    own = np.sqrt(np.maximum(2 - 2 * np.einsum("bcd,bd->bc", vectors, x[nodes]), 0))
    alive = candidates != nodes[:, None]
    out = np.full((len(nodes), degree), -1, dtype=np.int64)
    rows = np.arange(len(nodes))
    for i in range(degree):
        distance = np.where(alive, own, np.inf)
        best = distance.argmin(axis=1)
        some = np.isfinite(distance[rows, best])
        if not some.any():
            break
        out[some, i] = candidates[rows, best][some]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("bcd,bd->bc", vectors, vectors[rows, best]), 0))
        alive &= ~(some[:, None] & (alpha * between <= own))
        alive[rows, best] = False
        alive &= candidates != candidates[rows, best][:, None]
    return out


def build_graph(x: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Adjacency lists of a shard; ``x`` has unit rows. Every node can be reached from the medoid."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = min(NEAREST, n - 1)
    pairs = []
    for at in range(0, n, 512):
        nodes = np.arange(at, min(n, at + 512))
        sims = x[nodes] @ x.T
        sims[np.arange(len(nodes)), nodes] = -2
        closest = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else np.zeros((len(nodes), 0), np.int64)
        candidates = np.concatenate([closest, rng.integers(0, n, (len(nodes), RANDOM))], axis=1)
        chosen = robust_prune(x, nodes, candidates)
        a, i = np.nonzero(chosen >= 0)
        pairs.append(np.stack([nodes[a], chosen[a, i]], axis=1))
    edges = np.concatenate(pairs)
    lists = _lists(np.concatenate([edges, edges[:, ::-1]]), n)
    start = medoid(x)
    while True:
        seen = reached(lists, start, n)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return lists
        found = np.flatnonzero(seen)
        nearest = found[np.concatenate([(x[lost[i : i + 512]] @ x[found].T).argmax(axis=1) for i in range(0, len(lost), 512)])]
        extra = np.stack([nearest, lost], axis=1)
        lists = _lists(np.concatenate([np.stack([np.repeat(np.arange(n), [len(v) for v in lists]), np.concatenate(lists)], axis=1), extra, extra[:, ::-1]]), n)


def _lists(edges: np.ndarray, n: int) -> list[np.ndarray]:
    keys = np.unique(edges[:, 0] * n + edges[:, 1])
    a, b = keys // n, keys % n
    return np.split(b[a != b], np.searchsorted(a[a != b], np.arange(1, n)))


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def reached(lists: list[np.ndarray], start: int, n: int) -> np.ndarray:
    seen = np.zeros(n, dtype=bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        new = np.unique(np.concatenate([lists[i] for i in front.tolist()]))
        front = new[~seen[new]]
        seen[front] = True
    return seen


def padded(lists: list[np.ndarray]) -> np.ndarray:
    """Lists as one array, filled up with -1."""
    sizes = np.array([len(v) for v in lists])
    out = np.full((len(lists), max(1, int(sizes.max(initial=0)))), -1, dtype=np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate(lists) if sizes.sum() else []
    return out


def range_search(x: np.ndarray, table: np.ndarray, start: int, queries: np.ndarray, least: float) -> np.ndarray:
    """Which nodes each query's search meets with a cosine of ``least - SLACK`` or more (queries x nodes)."""
    n, q = len(x), len(queries)
    rows = np.arange(q)
    target = x[queries]
    visited = np.zeros((q, n), dtype=bool)
    in_range = np.zeros((q, n), dtype=bool)
    floor = least - SLACK
    beam = np.full((q, BEAM), -1, dtype=np.int64)
    score = np.full((q, BEAM), -np.inf, dtype=np.float32)
    done = np.zeros((q, BEAM), dtype=bool)
    beam[:, 0], score[:, 0] = start, target @ x[start]
    visited[:, start] = True
    in_range[:, start] = score[:, 0] >= floor
    active = rows
    while len(active):
        open_score = np.where(done[active] | (beam[active] < 0), -np.inf, score[active])
        pick = open_score.argmax(axis=1)
        going = np.isfinite(open_score[np.arange(len(active)), pick])
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        around = table[beam[active, pick]]
        fresh = (around >= 0) & ~visited[active[:, None], np.maximum(around, 0)]
        r, c = np.nonzero(fresh)
        who, node = active[r], around[r, c]
        visited[who, node] = True
        sims = np.full(around.shape, -np.inf, dtype=np.float32)
        sims[r, c] = np.einsum("ij,ij->i", target[who], x[node])
        hit = sims[r, c] >= floor
        in_range[who[hit], node[hit]] = True
        all_nodes = np.concatenate([beam[active], around], axis=1)
        all_scores = np.concatenate([score[active], sims], axis=1)
        all_done = np.concatenate([done[active], np.zeros(around.shape, dtype=bool)], axis=1)
        keep = np.argpartition(-all_scores, BEAM - 1, axis=1)[:, :BEAM]
        take = np.arange(len(active))[:, None]
        beam[active], score[active], done[active] = all_nodes[take, keep], all_scores[take, keep], all_done[take, keep]
        beam[active] = np.where(np.isfinite(score[active]), beam[active], -1)
    front_q, front_n = np.nonzero(in_range)
    while len(front_q):
        news_q, news_n = [], []
        for at in range(0, len(front_q), PAIRS_AT_ONCE // 8):
            fq, fn = front_q[at : at + PAIRS_AT_ONCE // 8], front_n[at : at + PAIRS_AT_ONCE // 8]
            around = table[fn]
            fresh = (around >= 0) & ~visited[fq[:, None], np.maximum(around, 0)]
            r, c = np.nonzero(fresh)
            keys = np.unique(fq[r] * n + around[r, c])
            a, b = keys // n, keys % n
            visited[a, b] = True
            hit = np.einsum("ij,ij->i", target[a], x[b]) >= floor
            in_range[a[hit], b[hit]] = True
            news_q.append(a[hit])
            news_n.append(b[hit])
        front_q, front_n = np.concatenate(news_q), np.concatenate(news_n)
    return in_range


def shard_links(vectors: np.ndarray, lists: list[np.ndarray], weights: np.ndarray, shards: list[list[int]], shard: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links that count in this shard, and the local component, of each node."""
    n = len(vectors)
    exact = vectors
    lengths = np.sqrt(np.einsum("ij,ij->i", exact, exact))
    x = (exact / lengths[:, None]).astype(np.float32)
    table, start = padded(lists), medoid(x)
    found = np.zeros((n, n), dtype=bool)
    for at in range(0, n, QUERIES_AT_ONCE):
        queries = np.arange(at, min(n, at + QUERIES_AT_ONCE))
        found[queries] = range_search(x, table, start, queries, least)
    found |= found.T
    np.fill_diagonal(found, False)
    width = max(map(len, shards))
    homes = np.full((n, width), -1, dtype=np.int64)
    for i, s in enumerate(shards):
        homes[i, : len(s)] = sorted(s)
    counts = np.zeros(n, dtype=np.int64)
    label = np.arange(n)
    links_a, links_b = [], []
    for at in range(0, n, QUERIES_AT_ONCE):
        a, b = np.nonzero(found[at : at + QUERIES_AT_ONCE])
        a += at
        for i in range(0, len(a), PAIRS_AT_ONCE):
            p, q = a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]
            cosine = np.einsum("ij,ij->i", exact[p], exact[q]) / (lengths[p] * lengths[q])
            p, q = p[cosine >= least], q[cosine >= least]
            common = np.where((homes[p][:, :, None] == homes[q][:, None, :]).any(axis=2) & (homes[p] >= 0), homes[p], np.iinfo(np.int64).max).min(axis=1) if len(p) else np.zeros(0, np.int64)
            np.add.at(counts, p[common == shard], weights[q[common == shard]])
            links_a.append(p.astype(np.int32))
            links_b.append(q.astype(np.int32))
    p, q = np.concatenate(links_a or [np.zeros(0, np.int32)]), np.concatenate(links_b or [np.zeros(0, np.int32)])
    while len(p):
        low = label.copy()
        np.minimum.at(low, p, label[q])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return counts, label


# the Spark side


def _nodes(batch: pa.Table) -> tuple[list[int], np.ndarray]:
    reps = batch.column("rep").to_pylist()
    return reps, np.stack([np.frombuffer(v, dtype="<f8") for v in batch.column("vec").to_pylist()])


def _build(table: pa.Table) -> pa.Table:
    reps, vectors = _nodes(table)
    lists = build_graph(unit(vectors).astype(np.float32)) if len(reps) > 1 else [np.zeros(0, np.int64)]
    names = np.array(reps, dtype=np.int64)
    return pa.table({"rep": pa.array(reps, pa.int64()), "around": pa.array([names[v] for v in lists], pa.list_(pa.int64()))})


def _search(least: float):
    def run(table: pa.Table) -> pa.Table:
        reps, vectors = _nodes(table)
        place = {r: i for i, r in enumerate(reps)}
        lists = [np.array([place[v] for v in (around or ()) if v in place], dtype=np.int64) for around in table.column("around").to_pylist()]
        counts, label = shard_links(vectors, lists, table.column("m").to_numpy(), table.column("shards").to_pylist(), table.column("shard")[0].as_py(), least)
        # The component's least id, so that components merge to their least member.
        names = np.array(reps, dtype=np.int64)
        low = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(low, label, names)
        return pa.table({"rep": names, "n": counts, "root": low[label]})

    return run


def _assign(classes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """``(rep, vec, m, cluster)``, a row for each of the ``overlap`` nearest centres."""
    k = min(overlap, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.stack([np.frombuffer(v, dtype="<f8") for v in batch.column(1).to_pylist()])).astype(np.float32)
            far = -(x @ centres.T)
            near = np.argpartition(far, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], ["rep", "vec", "m", "clusters"])

    return arrow_map(classes.select("rep", "vec", "m"), run, "rep long, vec binary, m long, clusters array<int>")


def _one_dimension(classes: DataFrame, n: int, size: int, least: float, overlap: int, build=_build, search=_search) -> DataFrame:
    """``(rep, n, root)`` rows, several for a node, of n classes with vectors of ``size`` bytes; with overlap 0 there is one cluster."""
    k = min(CLUSTERS_MOST, -(-n * overlap // SHARD)) if overlap else 1
    most = max(8, SAMPLE_BYTES // max(1, size))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(min(SAMPLE, max(16 * k, 4096), most)).select("vec").collect()
    x = unit(np.stack([np.frombuffer(r["vec"], dtype="<f8") for r in sample])).astype(np.float32)
    k = max(1, min(k, len(x) // 8))
    assigned = cut(_assign(classes, kmeans(x, k), max(1, overlap)))
    sizes = assigned.select(F.explode("clusters").alias("cluster")).groupBy("cluster").count().collect()  # CLUSTERS_MOST rows at most
    parts = {r["cluster"]: -(-r["count"] // (SHARD if r["count"] <= SHARD else SHARD // 2)) for r in sizes}
    first, names = {}, 0
    for c in sorted(parts):
        first[c] = names
        names += parts[c] * (parts[c] + 1) // 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Part i of p meets part j in shard number (i, j), i <= j, counted row by row from the cluster's first.
        for batch in batches:
            homes = []
            for rep, clusters in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = []
                for c in clusters:
                    size = parts[c]
                    i = (((rep * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 32) % size
                    own += [first[c] + low * size - low * (low - 1) // 2 + high - low for low, high in ((min(i, j), max(i, j)) for j in range(size))]
                homes.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(homes, pa.list_(pa.int64()))], ["rep", "vec", "m", "shards"])

    placed = arrow_map(assigned, place, "rep long, vec binary, m long, shards array<long>")
    dealt = placed.select("rep", "vec", "m", "shards", F.explode("shards").alias("shard"))
    around = dealt.select("shard", "rep", "vec").groupBy("shard").applyInArrow(build, "rep long, around array<long>")
    united = around.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around"))
    return dealt.join(cut(united), "rep").select("shard", "rep", "vec", "m", "shards", "around").groupBy("shard").applyInArrow(search(least), "rep long, n long, root long")


def links_and_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, overlap: int = 2) -> DataFrame:
    """``(id, n_links, component)`` for every row of ``vectors``."""
    spark = vectors.sparkSession
    ship_package(spark)
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                ok = v is not None and len(v) and None not in v
                a = np.array(v, dtype="<f8") + 0.0 if ok else None
                norm = float(np.sqrt(a @ a)) if a is not None and np.isfinite(a).all() else 0.0
                if not np.isfinite(norm) or (a is not None and norm == 0.0 and np.abs(a).max() > 0):
                    a = a / np.abs(a).max()
                    norm = 1.0
                out.append(a.tobytes() if norm > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    rows = cut(arrow_map(raw, pack, "id long, vec binary"))
    usable = rows.where("id is not null and vec is not null")
    classes = cut(usable.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    by_size = {r["d"]: r["n"] for r in classes.groupBy(F.octet_length("vec").alias("d")).agg(F.count("*").alias("n")).collect()}
    result = None
    while True:
        found = None
        for d, n in sorted(by_size.items()):
            part = _one_dimension(classes.where(F.octet_length("vec") == d), n, d, least, overlap)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
        found = cut(found)
        components = connected_components(found.where("rep <> root").select("rep", "root"), "rep", "root")
        counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
        nodes = classes.join(counts, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
        nodes = cut(nodes.select("vec", "rep", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
        share = recall(nodes, classes, least)
        log.info("overlap %d: recall %.4f", overlap, share)
        if not overlap or share >= TARGET_RECALL:
            result = nodes
            break
        overlap = 2 * overlap if 2 * overlap <= OVERLAP_MOST else 0
    linked = usable.join(result, "vec").select("id", F.col("n_links").cast("long").alias("n_links"), "component")
    alone = rows.where("id is null or vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)


def recall(nodes: DataFrame, classes: DataFrame, least: float, audited: int = AUDITED) -> float:
    """The mean, over audited nodes with links to other vectors, of the share of these that was found.

    Nodes are drawn by a hash, whatever was found of them, and compared with all rows.
    """
    picked = nodes.orderBy(F.xxhash64("rep", F.lit(6)), "rep").limit(audited).join(classes.select("rep", "m"), "rep").collect()
    found: dict[int, int] = {}
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["vec"]) // 8 for r in picked}:
        own = [r for r in picked if len(r["vec"]) == 8 * d]
        found |= {r["rep"]: r["n_links"] - r["m"] + 1 for r in own}
        queries[d] = np.array([r["rep"] for r in own], dtype=np.int64), unit(np.stack([np.frombuffer(r["vec"], "<f8") for r in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = {d: np.zeros(len(names), dtype=np.int64) for d, (names, _) in queries.items()}
        for batch in batches:
            reps, vectors, times = (batch.column(i).to_pylist() for i in range(3))
            for d, (names, q) in queries.items():
                same = [i for i, v in enumerate(vectors) if len(v) == 8 * d]
                for at in range(0, len(same), 2048):
                    part = same[at : at + 2048]
                    near = unit(np.stack([np.frombuffer(vectors[i], "<f8") for i in part])) @ q.T >= least
                    near &= np.array([reps[i] for i in part])[:, None] != names
                    met[d] += np.array([times[i] for i in part]) @ near
        for d, (names, _) in queries.items():
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(met[d])], ["rep", "n"])

    there = arrow_map(classes.select("rep", "vec", "m"), run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).where("n > 0").collect()
    return float(np.mean([min(1.0, found[r["rep"]] / r["n"]) for r in there])) if there else 1.0
