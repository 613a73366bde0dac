"""Interleave sources so that every prefix keeps to target weights.

Each source's documents are dealt into blocks; the last may be short. The
target is what sources would have had if they ran side by side at the rates of
their weights, a source that ends leaving its share to the others in
proportion. In that ideal run, after ``j / w`` units of time for block j of a
source of weight w, ``T`` blocks are through in all: the weights of the sources
still running times that time, and the blocks of those that ended. Block j may
run from slot ``floor(T)`` of the block before it, and must by ``ceil(T)`` of its
own; of the blocks that may run, the one with the earliest deadline takes the
next slot. Every deadline is met, and at no slot, up to the last, has a source
run a whole block more or less than the ideal run.

Sources, boundaries of blocks and segments are tables. Boundaries are sorted
by their time, so that running sums give ``T`` in whole numbers; time is cut into
segments that tasks schedule on their own: which blocks have run at a cut
follows from the blocks released shortly before it (``run_before``), such that
the segments on both sides can meet their deadlines. A segment is at least as
long as the longest time between a release and its deadline. Rates are the
weights in units of 2**-60 of their sum, one unit at least.

``_on_target`` marks the slots that the weights rule: all but those of sources
of weight 0.

With ``period`` given, weights are rounded to multiples of ``1 / period``
instead, one period of slots repeats, and a slot whose source has run out
stays empty. The deviation is then under a block from the rounded weights
only, until the first source has no full block left (``_on_target`` marks the
slots before), and the sources are as many as the period has slots at most.

No document is dropped or repeated.

Defined results: rows without source form a source of their own; a source
without a target weight, or of weight 0, comes after all others, in turns (with
``period``: gets one block a period); without a weight for any source all are
equal; rows equal in all columns take neighbouring places; NULL or empty texts
are placed like others; an empty table gives an empty result; other columns
are kept, whatever their names (but for the three added, which replace columns
so named). Weights that are negative, not finite or all zero, or more sources
than a given period has slots, raise a ValueError.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirescope.llm.common import packed, stored

BLOCK_DOCS = 16
PERIOD = 1000
# Slots that one task schedules at a time, at least.
SEGMENT_SLOTS = 20_000
# Blocks of a source that one row makes.
CHUNK_BLOCKS = 10_000
# Rows ranked by one task at a time.
RANK_ROWS = 1000
# Default targets: sizes to this power, between equal shares (0) and as is (1).
TEMPERATURE = 0.5


def _check(weights: dict) -> None:
    if not all(w >= 0 and math.isfinite(w) for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be finite, not negative and not all zero")


def boundary_time(block: int, rate: int) -> str:
    """When a source of that rate has run that many blocks, ``block / rate``, in
    digits that sort like the exact fractions (rates below 2**61): two that
    differ do so by more than 2**-122."""
    return f"{(block << 130) // rate:048x}"


def by_deadline(jobs, start: int, stop: int):
    """``(job, slot)``: jobs ``(deadline, source, block, release)`` by earliest
    deadline among those released, from slot ``start`` to before ``stop``."""
    waiting = sorted(jobs, key=lambda job: (job[3], job), reverse=True)
    ready: list[tuple] = []
    for slot in range(start, stop):
        while waiting and waiting[-1][3] <= slot:
            heapq.heappush(ready, waiting.pop())
        if ready:
            yield heapq.heappop(ready), slot


def run_before(jobs, at: int, ended: int, longest: int) -> set:
    """Of the jobs whose deadline lies after slot ``at``, those that run before it.

    ``ended`` jobs have their deadline by then; the others that fill the slots
    must have had slots since their release (or what lies before fails), and
    should be those due first (or what follows does). Releases make the sets
    that had slots a matroid, whose best set for the order of deadlines is what
    earliest deadline first runs; looking back as far as the longest time
    between a release and its deadline is enough."""
    since = max(0, at - longest)
    had = [job for job, _ in by_deadline([j for j in jobs if since <= j[3] < at], since, at) if job[0] > at]
    return set(sorted(had)[:at - ended])


def segment(jobs, k: int, slots: int, stop: int, ended: dict, longest: int):
    """``(job, slot)`` in the k-th segment of ``slots`` slots, from the jobs whose
    time from release to deadline meets it or the ``longest`` before; ``ended``
    jobs had their deadline by its start and end."""
    start, end = k * slots, min((k + 1) * slots, stop)
    done = run_before(jobs, start, ended[start], longest)
    more = None if end == stop else run_before(jobs, end, ended[end], longest)
    todo = [j for j in jobs if j[0] > start and j not in done and (more is None or j[0] <= end or j in more)]
    out = list(by_deadline(todo, start, end))
    if len(out) != end - start or len(out) != len(todo):
        raise RuntimeError(f"segment {k} runs {len(out)} of {len(todo)} blocks in {end - start} slots")
    return out


def shares(weights: dict, period: int = PERIOD) -> dict:
    """Blocks per period of each source: largest remainders, one at least."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit a period of {period} slots")
    _check(weights)
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    left = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s is None, s or ""))[:left]:
        out[s] += 1
    return out


def one_period(blocks: dict, period: int = PERIOD) -> list[tuple]:
    """``(source, i, slot)``: the slot of each source's i-th block (from 0) in a
    period, by earliest deadline among the blocks released."""
    order = {s: k for k, s in enumerate(sorted(blocks, key=lambda s: (s is None, s or "")))}
    waiting = [(0, order[s], s, 0) for s in blocks]  # by release time
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // blocks[s]), k, s, i))
        _, k, s, i = heapq.heappop(ready)
        out.append((s, i, slot))
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * period // blocks[s], k, s, i + 1))
    return out


def _boundaries(batches):
    """The end of every block of the sources' chunks, with its time."""
    for batch in batches:
        for name, rate, blocks, chunk in zip(*(c.to_pylist() for c in batch.columns)):
            first, last = chunk * CHUNK_BLOCKS + 1, min(blocks, (chunk + 1) * CHUNK_BLOCKS)
            if first <= last:
                n = last - first + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([boundary_time(j, rate) for j in range(first, last + 1)]), pa.array([name] * n, pa.string()),
                     pa.array([rate] * n, pa.int64()), pa.array([blocks] * n, pa.int64()), pa.array(range(first, last + 1), pa.int64())],
                    ["time", "_s", "rate", "blocks", "block"])


def _ended_before(batches):
    """Sums over the rows before, in this task: rates and blocks of the sources
    that ended, and the task's number."""
    part, rates, blocks = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        last = batch.column("block").to_numpy() == batch.column("blocks").to_numpy()
        rate = np.where(last, batch.column("rate").to_numpy(), 0)
        block = np.where(last, batch.column("block").to_numpy(), 0)
        sums = [rates + np.cumsum(rate), blocks + np.cumsum(block)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_s"), batch.column("rate"), batch.column("blocks"), batch.column("block"),
             pa.array(np.full(len(rate), part, np.int32)), *map(pa.array, sums)],
            ["_s", "rate", "blocks", "block", "part", "rates_to", "blocks_to"])
        if len(rate):
            rates, blocks = int(sums[0][-1]), int(sums[1][-1])


def _windows(sources: DataFrame) -> DataFrame:
    """``(_s, block, release, deadline)`` of every block (from 1) of the sources
    (``_s, rate, blocks``)."""
    chunks = sources.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {CHUNK_BLOCKS}"))))
    ends = chunks.repartition("_s", "chunk").mapInArrow(
        _boundaries, "time string, _s string, rate long, blocks long, block long")
    ends = stored(ends.repartitionByRange("time").sortWithinPartitions("time").mapInArrow(
        _ended_before, "_s string, rate long, blocks long, block long, part int, rates_to long, blocks_to long"), "mixing-ends")
    # One row per task of the sort.
    parts = ends.groupBy("part").agg(F.max("rates_to").alias("rates"), F.max("blocks_to").alias("ended"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("rates", "ended")])
    total = sources.agg(F.sum("rate")).scalar()
    own = F.col("block") == F.col("blocks")
    still = total - F.col("rates") - F.col("rates_to") + F.when(own, F.col("rate")).otherwise(0)
    before = F.col("ended") + F.col("blocks_to") - F.when(own, F.col("block")).otherwise(0)
    timed = ends.join(parts, "part").withColumn("before", before).withColumn(
        "run", still.cast("decimal(19,0)") * F.col("block").cast("decimal(18,0)")).withColumn(
        "whole", F.expr("run div CAST(rate AS DECIMAL(19,0))")).withColumn(
        "over", F.expr("run > CAST(whole AS DECIMAL(19,0)) * CAST(rate AS DECIMAL(19,0))"))
    low = F.col("before") + F.col("whole")
    none = F.lit(None).cast("long")
    due = F.struct(F.col("block").alias("block"), none.alias("release"), (low + F.col("over").cast("int")).alias("deadline"))
    next_ = F.struct((F.col("block") + 1).alias("block"), low.alias("release"), none.alias("deadline"))
    both = timed.select("_s", F.explode(F.when(own, F.array(due)).otherwise(F.array(due, next_))).alias("w"))
    return both.groupBy("_s", F.col("w.block").alias("block")).agg(
        F.coalesce(F.max("w.release"), F.lit(0)).alias("release"), F.max("w.deadline").alias("deadline"))


def _exact_slots(sources: DataFrame, least: int) -> DataFrame:
    """``(_s, _block, _slot)`` of every block of the sources (``_s, rate, blocks``),
    in segments of ``least`` slots or more."""
    windows = stored(_windows(sources), "mixing-windows")
    stop, longest = windows.agg(F.count(F.lit(1)), F.max(F.col("deadline") - F.col("release"))).first()
    slots = max(least, longest or 1)
    # A count for each cut, one row for every ``slots`` blocks.
    due = windows.groupBy(F.expr(f"(deadline + {slots - 1}) div {slots}").alias("cut")).agg(F.count(F.lit(1)).alias("n"))
    cuts = sources.sparkSession.range(0, -(-stop // slots) + 1).select(F.col("id").alias("cut")).join(due, "cut", "left")
    ended = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("cut"))
    cuts = cuts.select("cut", ended.alias("block")).select(
        F.explode(F.array("cut", F.col("cut") - 1)).alias("k"), F.lit(None).cast("string").alias("_s"), "block",
        F.lit(-1).cast("long").alias("release"), (F.col("cut") * slots).alias("deadline"))
    dealt = windows.select(F.explode(F.sequence(F.expr(f"release div {slots}"), F.expr(
        f"least((deadline + {longest} - 1) div {slots}, {max(0, stop - 1)} div {slots})"))).alias("k"), "_s", "block", "release", "deadline")

    def schedule(rows: pa.Table) -> pa.Table:
        k, jobs, counts, out = rows.column("k")[0].as_py(), [], {}, []
        for job in zip(*(rows.column(c).to_pylist() for c in ("deadline", "_s", "block", "release"))):
            if job[3] < 0:
                counts[job[0]] = job[2]
            else:
                jobs.append(job)
        if 0 <= k and k * slots < stop:
            out = segment(jobs, k, slots, stop, counts, longest)
        return pa.table([pa.array([j[1] for j, _ in out], pa.string()), pa.array([j[2] - 1 for j, _ in out], pa.int64()),
                         pa.array([x for _, x in out], pa.int64())], ["_s", "_block", "_slot"])

    done = dealt.unionByName(cuts).groupBy("k").applyInArrow(schedule, "_s string, _block long, _slot long")
    return stored(done, "mixing-slots")


def _all_slots(sizes: DataFrame, weights: dict | None, block_docs: int, temperature: float) -> tuple[DataFrame, int]:
    """``(_s, _block, _slot)`` of every block of the sources (``_s, n``), and how
    many slots the weights rule."""
    spark = sizes.sparkSession
    if weights is None:
        rows = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = spark.createDataFrame([(_named(s), float(w)) for s, w in weights.items()], "_s string, w double")
        rows = sizes.join(given, "_s", "left")
    rows = stored(rows.select("_s", "w", F.expr(f"(n + {block_docs - 1}) div {block_docs}").alias("blocks")), "mixing-sources")
    bad = F.count_if(F.isnan("w") | (F.col("w") < 0) | (F.col("w") == F.lit(math.inf)))
    known, bad, total, late = rows.agg(F.count("w"), bad, F.sum("w"), F.count_if(F.coalesce("w", F.lit(0.0)) == 0)).first()
    if not known:  # no source has a weight
        rows, total, late = rows.withColumn("w", F.lit(1.0)), rows.count(), 0
    elif bad or not total > 0 or not math.isfinite(total):
        raise ValueError("weights must be finite, not negative and not all zero")
    rate = F.greatest(F.lit(1).cast("long"), F.floor(F.col("w") / F.lit(float(total)) * F.lit(2.0**60)))
    ruled = rows.where("w > 0").select("_s", rate.alias("rate"), "blocks")
    slots = _exact_slots(ruled, SEGMENT_SLOTS)
    stop = ruled.agg(F.sum("blocks")).first()[0]
    if late:
        rest = _exact_slots(rows.where("coalesce(w, 0) = 0").select("_s", F.lit(1).cast("long").alias("rate"), "blocks"), SEGMENT_SLOTS)
        slots = slots.union(rest.withColumn("_slot", F.col("_slot") + stop))
    return slots, stop


def _named(source) -> str:
    """Rows without source have a name as well."""
    return "" if source is None else f"={source}"


def mixed(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, period: int | None = None,
          temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """``docs`` (all columns; needs ``doc_id``, ``text``, ``source``) with
    ``_slot`` (of its block), ``_place`` (in the block) and ``_on_target``."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("_slot", "_place", "_on_target")]
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sizes = stored(docs.groupBy(name.alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "mixing-sizes")
    if sizes.isEmpty():
        return docs.select(*names, F.lit(0).cast("long").alias("_slot"), F.lit(0).cast("int").alias("_place"),
                           F.lit(True).alias("_on_target"))

    # A random but repeatable order: parts of a source by one hash, rows of a
    # part by another. The number of parts grows with the source.
    per_source = sizes.select("_s", F.expr(f"(n + {RANK_ROWS - 1}) div {RANK_ROWS}").alias("_parts"))
    rows, column = packed(docs, "doc_id", "text", "source")
    keyed = rows.withColumn("_s", name).join(per_source, "_s").withColumn(
        "_h", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("_part", F.pmod("_h", F.col("_parts")))
    counts = keyed.groupBy("_s", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    in_part = Window.partitionBy("_s", "_part").orderBy(F.xxhash64("_h"), "doc_id")
    ranked = keyed.withColumn("_rank", F.row_number().over(in_part) - 1)
    rank = F.col("_rank") + F.col("_offset")
    block = F.expr(f"(_rank + _offset) div {block_docs}")
    if period is None:
        slots, first_empty = _all_slots(sizes.select("_s", "n"), weights, block_docs, temperature)
        # The slots of a part's blocks come as one list, so that the rows
        # themselves are dealt out no second time.
        held = offsets.withColumn("_first", F.expr(f"_offset div {block_docs}")).withColumn(
            "_block", F.explode(F.sequence("_first", F.expr(f"(_offset + _n - 1) div {block_docs}"))))
        lists = held.join(slots, ["_s", "_block"]).groupBy("_s", "_part").agg(
            F.first("_offset").alias("_offset"), F.first("_first").alias("_first"),
            F.sort_array(F.collect_list(F.struct("_block", "_slot"))).alias("_slots"))
        placed = ranked.join(lists, ["_s", "_part"])
        slot = F.get("_slots", (block - F.col("_first")).cast("int"))["_slot"]
    else:
        n = {r["source"]: r["n"] for r in sizes.limit(period + 1).collect()}
        if len(n) > period:
            raise ValueError(f"more sources than a period has slots ({period})")
        if weights is None:
            weights = {s: k**temperature for s, k in n.items()}
        asked = {s: weights.get(s, 0) for s in n} if any(s in weights for s in n) else {s: 1 for s in n}
        blocks = shares(asked, period)
        at = {(s, i): x for s, i, x in one_period(blocks, period)}
        first_empty = min((k // block_docs) // blocks[s] * period + at[s, (k // block_docs) % blocks[s]]
                          for s, k in n.items())
        # Bounded by the number of slots of a period, whatever the input.
        per_block = F.broadcast(spark.createDataFrame([(_named(s), i, at[s, i]) for s in n for i in range(blocks[s])],
                                                      "_s string, _i int, _at int"))
        counted = F.broadcast(spark.createDataFrame([(_named(s), blocks[s]) for s in n], "_s string, _blocks int"))
        placed = ranked.join(offsets, ["_s", "_part"]).join(counted, "_s").withColumn(
            "_i", F.pmod(block, "_blocks").cast("int")).join(per_block, ["_s", "_i"])
        slot = F.expr(f"((_rank + _offset) div {block_docs} div _blocks) * {period} + _at")
    return placed.select(*map(column, names), slot.alias("_slot"), (rank % block_docs).cast("int").alias("_place"),
                         (slot < first_empty).alias("_on_target"))
