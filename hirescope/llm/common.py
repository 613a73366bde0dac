"""Helpers shared by the operators of this subpackage."""

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope.sources.sinks import stage

# Rows are handed to Python code in slices of about this many text bytes, so a
# batch of long documents does not multiply in memory.
SLICE_BYTES = 4 << 20
# Bytes of a record batch on its way to Python code, while a table is written.
BATCH_BYTES = 8 << 20
# Bytes a task must have read for its memory to be worth giving back.
LEAN_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Record batches of at most ``BATCH_BYTES`` for what runs inside; the
    session's own setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage with a written table, so a lost executor never recomputes
    what came before. ``release_staged`` deletes the folder.
    """
    with _small_batches(df.sparkSession):
        return stage(df, name)


def lean(run, *caches):
    """``run``, a function over record batches, that gives its memory back when
    its task ends: Python workers outlive their tasks, and those of several
    stages wait side by side. A task of few bytes leaves that to the next one
    of the worker. ``caches`` are cleared in any case."""
    def wrapped(batches):
        size = 0

        def weighed():
            nonlocal size
            for batch in batches:
                size += batch.nbytes
                yield batch

        yield from run(weighed())
        for cache in caches:
            cache.cache_clear()
        if size < LEAN_BYTES:
            return
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what they freed
            ctypes.CDLL(None).malloc_trim(0)
    return wrapped


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a record batch where ``column`` has gathered ``SLICE_BYTES``."""
    start = size = 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def row_key(*cols: str):
    """64-bit key of a row by the named columns, NULLs told apart from empty
    texts; rows equal in all of them share the key."""
    return F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])


def packed(docs: DataFrame, *used: str):
    """``docs`` as the columns ``used`` and one struct, ``row``, of all others,
    so that no working column can clash with them, and a function that gives
    a column of ``docs`` back by its name."""
    others = [c for c in docs.columns if c not in used]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    places = {c: f"c{i}" for i, c in enumerate(others)}
    return (docs.select(*used, row.alias("row")),
            lambda c: F.col(c) if c in used else F.col("row")[places[c]].alias(c))


HOT_KEYS = 1000
# Links whose labels one task writes.
LINKS_PER_TASK = 500_000


def hot_key_join(rows: DataFrame, lookup: DataFrame, keys: list[str], counts: DataFrame,
                 total: int | None = None) -> DataFrame:
    """``rows`` inner-joined to ``lookup`` (one row per key), balanced however
    the rows are spread over the keys.

    ``counts`` has the keys and ``rows``, at most how many of ``rows`` each of
    them holds. Keys with more than a ``HOT_KEYS``-th of the total are at most
    ``HOT_KEYS`` by that, whatever the size of the input, so they are
    broadcast; the rows of all other keys meet in a shuffle. ``rows`` and
    ``lookup`` are read twice and should be stored. NULL keys match nothing.
    """
    if total is None:
        total = rows.count()
    hot = counts.where(F.col("rows") * HOT_KEYS > total).select(*keys)
    few = lookup.join(F.broadcast(hot), keys, "left_semi")
    apart = rows.join(F.broadcast(hot), keys, "left_anti").join(lookup, keys)
    names = [*rows.columns, *[c for c in lookup.columns if c not in keys]]
    return rows.join(F.broadcast(few), keys).select(*names).union(apart.select(*names))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``(node, component)``: the smallest node each node reaches.

    ``edges`` holds undirected links between 64-bit ids. Each round every node
    takes the smallest label among its own and its neighbours', then the label
    of that label (pointer jumping), so chains halve per round. Every round
    is a written table; rounds stop when no label changes. A hub's links are
    reduced by a partial ``min`` before the shuffle.
    """
    # Both directions come from one pass, so what makes the edges runs once.
    ends = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")),
                             F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("ends")
    links = stored(edges.select(ends).select("ends.u", "ends.v").distinct(), f"{name}-links")
    # Labels of few links are written by few tasks, however many a shuffle has.
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, links.count() // LINKS_PER_TASK)
    labels = stored(links.groupBy(F.col("u").alias("node"))
                    .agg(F.least(F.min("v"), F.col("node")).alias("component")).coalesce(tasks), f"{name}-0")
    rounds = 0
    while True:
        rounds += 1
        seen = links.join(labels, links["v"] == labels["node"]).select("u", "component", F.lit(None).cast("long").alias("own"))
        # A node's own label goes along, so it needn't be joined again.
        own = labels.select(F.col("node").alias("u"), "component", F.col("component").alias("own"))
        least = seen.union(own).groupBy("u").agg(F.min("component").alias("c"), F.max("own").alias("old"))
        roots = labels.select(F.col("node").alias("c"), F.col("component").alias("root"))
        new = least.join(roots, "c", "left").select(
            F.col("u").alias("node"), F.least(F.col("c"), F.coalesce("root", "c")).alias("component"), "old")
        new = stored(new.coalesce(tasks), f"{name}-{rounds}")
        changed = new.where(F.col("component") != F.col("old")).limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
