"""Near-duplicate vectors by a flat graph, built in shards and searched greedily.

1. Equal unit vectors form a class; what follows sees one of them, the one
   with the smallest vec_id, and links count the members of its class.
   Cluster centres are fitted on a bounded sample; every vector joins the
   shards of its nearest centres, so shards overlap. A shard larger than a
   block is dealt into blocks.
2. In each block a graph is built: each vector keeps, of its nearest, those
   that no kept one is closer to by a factor (robust pruning), and the ones
   that kept it. The adjacency lists of all shards are united.
3. Each block's vectors search the block, and the other blocks of their
   shard, from its medoid: greedily to their neighbourhood, then on through
   every vector found within range until no more turn up.
4. What is found counts only if the cosine, in double precision, reaches the
   threshold. A pair that shares several shards counts in the first of them.
   Blocks hand on numbers of links and local components, never pairs, so a
   clique costs rows in proportion to its members.
5. ``audit`` compares the links of a bounded sample of vectors with a scan of
   all vectors.

Defined results: vectors that are NULL, empty, zero, hold NULL or non-finite
components or have another dimension than most link with nothing; of several
rows with one vec_id the smallest vector stands and one row is returned; a
NULL vec_id has no component and no links; an empty table gives an empty
result; other columns are ignored.
"""

import warnings
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import components, stored

THRESHOLD = 0.95
# Bounded fitting sample, and the number of centres it can carry.
SAMPLE_VECTORS = 16_384
MAX_CENTRES = 1024
SHARD_VECTORS = 600
OVERLAP = 3
BLOCK_VECTORS = 1500
DEGREE = 16
CANDIDATES = 48
ALPHA = 1.2
BEAM = 16
AUDITED = 200
MIN_RECALL = 0.9


def _vectors(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, dim)


def _unit(dim: int):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("embedding").flatten(), np.float64).reshape(-1, dim)
            # Scaled first, so that squares neither overflow nor vanish.
            x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            x += 0.0  # one zero only, so that equal vectors are equal bytes
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["vec_id", "v"])
    return run


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a sample."""
    rng = np.random.default_rng(0)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.where(length > 0, length, 1), c)
    return c


def _assign(sent, dim: int, overlap: int):
    def run(batches):
        c = sent.value
        k = min(overlap, len(c))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch.column("v").to_pylist(), dim)
            near = np.sort(np.argpartition(-(v @ c.T), k - 1, axis=1)[:, :k], axis=1).astype(np.int32)
            rows = np.repeat(np.arange(len(v)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), batch.column("v").take(pa.array(rows)),
                 batch.column("size").take(pa.array(rows)),
                 pa.array(near.ravel()), pa.array(list(near[rows]), pa.list_(pa.int32()))],
                ["vec_id", "v", "size", "shard", "shards"])
    return run


def robust_graph(v: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each row: of its nearest rows, those not shadowed by a
    closer kept one, then the rows that kept it."""
    n = len(v)
    near = min(candidates, n - 1)
    if near < 1:
        return [np.empty(0, np.int64) for _ in range(n)]
    cand = np.empty((n, near), np.int64)
    for at in range(0, n, 512):
        sim = v[at:at + 512] @ v.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -2
        top = np.argpartition(-sim, near - 1, axis=1)[:, :near]
        cand[at:at + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1)
    dist = 1 - np.einsum("id,ijd->ij", v, v[cand])
    open_ = np.ones((n, near), bool)
    kept: list[list[int]] = [[] for _ in range(n)]
    rows = np.arange(n)
    for _ in range(min(degree, near)):
        live = rows[open_[rows].any(axis=1)]
        if not len(live):
            break
        pick = open_[live].argmax(axis=1)  # candidates come nearest first
        chosen = cand[live, pick]
        for i, c in zip(live.tolist(), chosen.tolist()):
            kept[i].append(c)
        between = 1 - np.einsum("id,ijd->ij", v[chosen], v[cand[live]])
        open_[live] &= alpha * between > dist[live]
        open_[live, pick] = False
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(kept):
        for c in own:
            if len(back[c]) < degree:
                back[c].append(i)
    # A ring over all rows keeps the graph in one piece whatever was pruned.
    return [np.unique(np.array([*kept[i], *back[i], (i + 1) % n], np.int64)) for i in range(n)]


def range_search(graph: np.ndarray, nodes: np.ndarray, start: int, queries: np.ndarray, threshold: float,
                 beam: int = BEAM) -> np.ndarray:
    """``found[q, node]`` within range. ``graph`` holds node numbers in rows of
    one length, filled up with -1; all queries take their steps together."""
    n, m = len(queries), len(nodes)
    similarity = np.full((n, m + 1), -2.0, np.float32)  # of nodes seen; the last column takes the -1
    expanded = np.zeros((n, m + 1), bool)
    expanded[:, m] = True
    q32, v32 = queries.astype(np.float32), nodes.astype(np.float32)
    similarity[:, start] = q32 @ v32[start]
    near = np.full((n, beam), m)  # the best nodes seen
    near[:, 0] = start
    active = np.arange(n)
    while len(active):
        value = np.take_along_axis(similarity[active], near[active], 1)
        value[np.take_along_axis(expanded[active], near[active], 1)] = -3
        # In the beam first; when that is expanded, on through what is in range.
        pick = value.argmax(axis=1)
        node = near[active, pick]
        stuck = value[np.arange(len(active)), pick] <= -2.5
        if stuck.any():
            rows = active[stuck]
            more = (similarity[rows, :m] >= threshold - 1e-3) & ~expanded[rows, :m]
            node[stuck] = np.where(more.any(axis=1), more.argmax(axis=1), -1)
        active, node = active[node >= 0], node[node >= 0]
        if not len(active):
            break
        expanded[active, node] = True
        nbrs = graph[node]
        new = similarity[active[:, None], nbrs] <= -1.5
        new &= nbrs >= 0
        r, c = np.nonzero(new)
        target = nbrs[r, c]
        similarity[active[r], target] = np.einsum("ij,ij->i", q32[active[r]], v32[target])
        pool = np.concatenate([near[active], np.where(new, nbrs, m)], axis=1)
        score = np.take_along_axis(similarity[active], pool, 1)
        score[pool == m] = -4
        top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        near[active] = np.take_along_axis(pool, top, 1)
    q, c = np.nonzero(similarity[:, :m] >= threshold - 1e-3)
    found = np.zeros((n, m), bool)
    for at in range(0, len(q), 65_536):
        a, b = q[at:at + 65_536], c[at:at + 65_536]
        found[a, b] = np.einsum("ij,ij->i", queries[a], nodes[b]) >= threshold
    return found


def _packed(ids: np.ndarray, neighbours) -> np.ndarray:
    """Neighbour ids, as far as they are among ``ids`` (sorted), as a matrix."""
    lists = []
    for nb in neighbours:
        nb = np.asarray(nb, np.int64)
        at = np.minimum(np.searchsorted(ids, nb), len(ids) - 1)
        lists.append(at[ids[at] == nb])
    graph = np.full((len(ids), max(1, max(map(len, lists), default=1))), -1)
    for i, at in enumerate(lists):
        graph[i, :len(at)] = at
    return graph


def _medoid(v: np.ndarray) -> int:
    return int((v @ v.mean(axis=0)).argmax())


def _search(dim: int, threshold: float):
    def side(rows: pd.DataFrame):
        rows = rows.sort_values("vec_id")
        ids, v = rows["vec_id"].to_numpy(), _vectors(rows["v"].tolist(), dim)
        return ids, v, _packed(ids, rows["neighbours"]), np.stack(rows["shards"].tolist()), _medoid(v), rows["size"].to_numpy()

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        shard, i, j = key
        a = side(rows[rows["own"] == i]) if (rows["own"] == i).any() else None
        b = a if i == j else side(rows[rows["own"] == j]) if (rows["own"] == j).any() else None
        if a is None or b is None:
            return pd.DataFrame({"vec_id": [], "links": [], "label": []}, dtype="int64")
        found = range_search(b[2], b[1], b[4], a[1], threshold)
        found |= found.T if i == j else range_search(a[2], a[1], a[4], b[1], threshold).T
        found &= a[0][:, None] != b[0][None, :]
        # Shards are listed in order: a pair belongs to the first it shares.
        q, c = np.nonzero(found)
        shared = a[3][q][:, :, None] == b[3][c][:, None, :]
        first = np.where(shared.any(axis=2), a[3][q], np.iinfo(np.int32).max).min(axis=1)
        own = first == shard
        q, c = q[own], c[own]
        links_a = np.bincount(q, b[5][c], len(a[0])).astype(np.int64)
        links_b = np.bincount(c, a[5][q], len(b[0])).astype(np.int64)
        ids = np.unique(np.concatenate([a[0], b[0]]))
        qa, cb = np.searchsorted(ids, a[0][q]), np.searchsorted(ids, b[0][c])
        label = np.arange(len(ids))
        while True:
            before = label.copy()
            np.minimum.at(label, qa, before[cb])
            np.minimum.at(label, cb, before[qa])
            label = label[label]
            if (label == before).all():
                break
        links = np.zeros(len(ids), np.int64)
        links[np.searchsorted(ids, a[0])] += links_a
        if i != j:
            links[np.searchsorted(ids, b[0])] += links_b
        ok = links > 0
        return pd.DataFrame({"vec_id": ids[ok], "links": links[ok], "label": ids[label][ok]})
    return run


def _build(dim: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        ids = rows["vec_id"].to_numpy()
        return pd.DataFrame({"vec_id": ids, "neighbours": [ids[g] for g in robust_graph(_vectors(rows["v"].tolist(), dim))]})
    return run


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame | None]:
    """``(vec_id, n_links, component_id, kept)``, one row per vector, and the
    stored unit vectors (for ``audit``; None if there are none)."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding",
                          F.coalesce(sound, F.lit(False)).alias("sound"))
    ids = rows.select("vec_id").distinct()
    good = rows.where("sound and vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    most = good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")).limit(1).collect()
    alone = ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                       F.lit(True).alias("kept"))
    if not most:
        return alone, None
    dim = most[0]["d"]
    unit = stored(good.where(F.size("embedding") == dim).mapInArrow(_unit(dim), "vec_id long, v binary"), "unit-vectors")
    of_class = F.sha2("v", 256).alias("class")
    classes = stored(unit.groupBy(of_class).agg(
        F.min("vec_id").alias("vec_id"), F.min("v").alias("v"), F.count(F.lit(1)).alias("size")), "vector-classes")
    n = classes.count()

    sample = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_VECTORS).collect()
    points = _vectors([r["v"] for r in sample], dim)
    k = max(1, min(MAX_CENTRES, -(-n // SHARD_VECTORS), len(points)))
    sent = spark.sparkContext.broadcast(centres(points, k))
    members = classes.select("vec_id", "v", "size").mapInArrow(
        _assign(sent, dim, OVERLAP), "vec_id long, v binary, size long, shard int, shards array<int>")
    # One row per centre, of which there are at most MAX_CENTRES.
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_VECTORS)).cast("int").alias("blocks"))
    members = stored(members.join(sizes, "shard").withColumn(
        "own", F.pmod(F.xxhash64("vec_id", "shard"), F.col("blocks")).cast("int")), "shard-members")

    lists = members.groupBy("shard", "own").applyInPandas(_build(dim), "vec_id long, neighbours array<long>")
    union = lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    pairs = members.join(union, "vec_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                         "vec_id", "v", "size", "shards", "neighbours")
    found = stored(pairs.groupBy("shard", "i", "j").applyInPandas(
        _search(dim, threshold), "vec_id long, links long, label long"), "vector-links")
    edges = found.where("vec_id != label").select(F.col("vec_id").alias("a"), F.col("label").alias("b"))
    labels = components(edges, name="vectors")
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    per_class = classes.join(counted, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "class", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component"))
    out = ids.join(unit.select("vec_id", of_class).join(per_class, "class"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")), unit


def audit(links: DataFrame, unit: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> tuple[int, int]:
    """Links found and links there are, over a bounded sample of vectors that
    a scan of all vectors checks; warns below ``MIN_RECALL``."""
    sample = unit.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(audited).collect()
    if not sample:
        return 0, 0
    dim = len(sample[0]["v"]) // 8
    sent = unit.sparkSession.sparkContext.broadcast(
        (np.array([r["vec_id"] for r in sample]), _vectors([r["v"] for r in sample], dim)))

    def scan(batches):
        ids, v = sent.value
        for batch in batches:
            own = batch.column("vec_id").to_numpy()
            near = (v @ _vectors(batch.column("v").to_pylist(), dim).T >= threshold) & (ids[:, None] != own[None, :])
            yield pa.record_batch([pa.array(ids), pa.array(near.sum(axis=1))], ["vec_id", "there"])

    there = unit.mapInArrow(scan, "vec_id long, there long").groupBy("vec_id").agg(F.sum("there").alias("there"))
    r = there.join(links, "vec_id").agg(F.sum("n_links").alias("found"), F.sum("there").alias("there")).first()
    found, there = r["found"] or 0, r["there"] or 0
    if found < MIN_RECALL * there:
        warnings.warn(f"the graph found {found} of {there} audited links", stacklevel=2)
    return found, there
