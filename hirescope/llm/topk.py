"""Exact top-k search by inner product over vectors of integers.

Vectors are taken by descending length. A rotation (the singular vectors of
all rows) moves most of a product into the first coordinates, so a partial sum
over them plus, by Cauchy-Schwarz, the product of the lengths of the rest is a
close upper bound. A candidate whose bound is below a query's k-th best score
so far is pruned; what is left is scored exactly, in integers.

The longest vectors, a fixed number, are sent to all tasks and give each query
its first k-th best score. Then blocks of queries meet blocks of candidates;
each meeting hands on at most k rows a query, and a last ranking merges them.

Defined results: vectors that are NULL, empty, hold NULL or non-finite
components, have no id, or another dimension than most take no part; of
several rows with one vec_id the smallest vector stands; ties go to the
smaller vec_id; fewer candidates than k give all of them; an empty table gives
an empty result; other columns are ignored. Vectors whose largest component
could make an inner product pass 64 bits (dimension times its square) are
refused by a ValueError, never scored wrongly.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirescope.llm.common import stored

K = 20
SCALE = 64.0
SEED_VECTORS = 2048
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
CHUNK = 512
# Rotated coordinates summed before each bound.
STEPS = (16, 32)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors that take part, one per vec_id."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).where(finite)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _integers(scale: float, dim: int):
    """Embeddings to 64-bit integers (as bytes) and their squared length."""
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("embedding").flatten(), np.float64).reshape(-1, dim)
            x = np.floor(scale * x)
            # Between any two vectors that pass, the sum of products is smaller.
            if len(x) and dim * np.abs(x).max() ** 2 >= 2.0**62:
                raise ValueError("components too large: their inner products could pass 64 bits")
            length = (x * x).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in x.astype(np.int64)], pa.binary()),
                 pa.array(length)], ["vec_id", "v", "length2"])
    return run


def _moments(dim: int):
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), dim).astype(np.float64)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])
    return run


def _matrix(values: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int64).reshape(-1, dim)


class _Side:
    """Vectors with what the bounds need."""

    def __init__(self, ids, v, rotation):
        self.ids, self.v = ids, v
        self.exact = v.astype(np.float64)
        self.rotated = self.exact @ rotation
        self.length = np.linalg.norm(self.exact, axis=1)
        rest = np.cumsum((self.rotated**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {h: np.sqrt(rest[:, h]) if h < v.shape[1] else np.zeros(len(v)) for h in STEPS}


def best_of_block(queries: _Side, candidates: _Side, floor: np.ndarray, k: int):
    """``(query, candidate, score)`` positions of each query's k best of the
    block, leaving out what is below ``floor`` and the query's own id."""
    order = np.argsort(-candidates.length, kind="stable")
    floor = floor.astype(np.float64).copy()
    dim = queries.v.shape[1]
    kept = [[], [], []]
    best = np.full((len(queries.ids), k), -np.inf)
    wide = queries.length.max(initial=0) * candidates.length.max(initial=0) >= 2**52
    for at in range(0, len(order), CHUNK):
        c = order[at:at + CHUNK]
        # Rounding of the rotated sums is far below this share of the lengths.
        slack = 1e-9 * queries.length * candidates.length[c[0]] + 1e-6
        live = np.flatnonzero(queries.length * candidates.length[c[0]] + slack >= floor)
        if not len(live):
            break  # every vector from here on is shorter still
        open_ = np.ones((len(live), len(c)), bool)
        partial, start = np.zeros((len(live), len(c))), 0
        for h in (h for h in STEPS if h < dim):
            partial += queries.rotated[live, start:h] @ candidates.rotated[c, start:h].T
            start = h
            bound = partial + np.outer(queries.rest[h][live], candidates.rest[h][c])
            open_ &= bound + slack[live, None] >= floor[live, None]
            if not open_.any():
                break
        open_ &= queries.ids[live, None] != candidates.ids[None, c]
        q, j = np.nonzero(open_)
        if not len(q):
            continue
        if wide:
            score = (queries.v[live[q]] * candidates.v[c[j]]).sum(axis=1)
        elif len(q) * 4 > open_.size:
            score = (queries.exact[live] @ candidates.exact[c].T)[q, j].astype(np.int64)
        else:
            score = np.einsum("ij,ij->i", queries.exact[live[q]], candidates.exact[c[j]]).astype(np.int64)
        grid = np.full(open_.shape, -np.inf)
        grid[q, j] = score
        merged = np.concatenate([best[live], grid], axis=1)
        best[live] = -np.partition(-merged, k - 1, axis=1)[:, :k]
        floor[live] = np.maximum(floor[live], best[live].min(axis=1))
        ok = score >= floor[live[q]]
        for out, x in zip(kept, (live[q][ok], c[j][ok], score[ok])):
            out.append(x)
    if not kept[0]:
        return (np.empty(0, np.int64),) * 3
    q, c, s = (np.concatenate(x) for x in kept)
    ok = s >= floor[q]
    q, c, s = q[ok], c[ok], s[ok]
    order = np.lexsort((candidates.ids[c], -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.searchsorted(q, q)
    top = np.arange(len(q)) - first < k
    return q[top], c[top], s[top]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` over ``floor(scale * component)``
    vectors; both inputs hold ``vec_id`` and ``embedding``."""
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score long"
    usable_rows = usable(vectors)
    dims = usable_rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = dims.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not most:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n = most[0]["d"], most[0]["n"]
    kinds = "vec_id long, v binary, length2 double"
    prepare = lambda df: df.where(F.size("embedding") == dim).mapInArrow(_integers(scale, dim), kinds)
    candidates = stored(prepare(usable_rows), "topk-candidates")
    moments = candidates.mapInArrow(_moments(dim), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    second = np.zeros((dim, dim))
    for r in moments.collect():  # dim * dim numbers
        second[r["i"], r["j"]] = r["s"]
    rotation = np.linalg.eigh(second)[1][:, ::-1].copy()
    seeds = candidates.orderBy(F.desc("length2"), "vec_id").limit(SEED_VECTORS).collect()
    sent = spark.sparkContext.broadcast(
        (rotation, np.array([r["vec_id"] for r in seeds]), _matrix([r["v"] for r in seeds], dim)))

    def first_floor(batches):
        rot, ids, v = sent.value
        longest = _Side(ids, v, rot)
        for batch in batches:
            own = _Side(batch.column("vec_id").to_numpy(), _matrix(batch.column("v").to_pylist(), dim), rot)
            floor = np.full(len(own.ids), -(2.0**63))
            if len(own.ids):
                q, _, s = best_of_block(own, longest, floor, k)
                full = np.bincount(q, minlength=len(floor)) >= k
                low = np.full(len(floor), np.inf)
                np.minimum.at(low, q, s)
                floor[full] = low[full]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(floor)],
                                             ["vec_id", "v", "floor"])

    asked = prepare(usable(queries)).mapInArrow(first_floor, "vec_id long, v binary, floor double")
    asked = stored(asked, "topk-queries")
    c_blocks, q_blocks = -(-n // CANDIDATE_BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))
    block = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = asked.withColumn("qb", block(q_blocks)).withColumn("cb", every(c_blocks))
    right = candidates.select("vec_id", "v").withColumn("cb", block(c_blocks)).withColumn("qb", every(q_blocks))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        rot = sent.value[0]
        qs = _Side(a["vec_id"].to_numpy(), _matrix(a["v"].tolist(), dim), rot)
        cs = _Side(b["vec_id"].to_numpy(), _matrix(b["v"].tolist(), dim), rot)
        q, c, s = best_of_block(qs, cs, a["floor"].to_numpy(), k)
        return pd.DataFrame({"query_id": qs.ids[q], "vec_id": cs.ids[c], "score": s.astype(np.int64)})

    met = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(meet, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
