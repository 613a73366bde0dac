"""Vector codes: each part of a vector as the number of its nearest codebook
entry, learned by exact rounds over flat, Hilbert-sorted blocks.

1. Components become integers ``floor(SCALE * x)``; a vector is cut into
   ``PARTS`` equal parts.
2. For each part position, the sub-vectors are sorted along a Hilbert curve and
   stored in flat blocks of ``BLOCK`` with their box (smallest and largest
   component), sums and count.
3. A round takes, per block, the distances of its box to the entries. An entry
   can be nearest to a member only if its least distance is not above the
   smallest greatest distance, so each block has a short list. A block with
   one entry on it is assigned whole, by its sums; the members of the others
   are compared with the listed entries only, in integers. Tasks hand on one
   row per part, entry and component.
4. After the last round every block is assigned once more, for the codes.

Blocks and rounds are Spark jobs over a stored table; the driver holds the
codebooks (``PARTS * ENTRIES`` entries) and one box per part. Every vector
takes part in every round, and the blocks change no result.

Defined results: vectors that are NULL, empty or hold NULL or non-finite
components, or have another dimension than most (of equally many the larger),
are left out; a dimension that ``PARTS`` does not divide is cut as evenly as
can be; rows equal in vec_id, label and vector travel as one with their count
and come back as so many rows; a row without vec_id is coded like any other
but comes last among the first entries; ties go to the entry of lower index;
fewer vectors than ``ENTRIES`` give fewer entries; an empty table gives an
empty result; other columns are ignored. Components whose squares could pass
64 bits are refused (``OverflowError``), never cut.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import hot_key_join, stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Sub-vectors in a block.
BLOCK = 64
# Blocks compared at a time.
BATCH_BLOCKS = 1024
HILBERT_BITS = 60


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points (rows) with ``bits`` bits to a coordinate."""
    x = x.astype(np.int64).copy()
    n, dims = x.shape
    if not dims:
        return np.zeros(n, np.int64)
    # From the highest bit down: turn or flip what lies in each half, so that
    # the halves follow one another; then undo the Gray code.
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(dims):
            upper = (x[:, k] & bit) != 0
            swap = (x[:, 0] ^ x[:, k]) & low
            x[:, 0] = np.where(upper, x[:, 0] ^ low, x[:, 0] ^ swap)
            if k:
                x[:, k] = np.where(upper, x[:, k], x[:, k] ^ swap)
        bit >>= 1
    for k in range(1, dims):
        x[:, k] ^= x[:, k - 1]
    flip = np.zeros(n, np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[:, -1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | ((x[:, k] >> b) & 1)
    return key


def _spans(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]


def _matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int64).reshape(len(values), dim)


def _integers(dim: int, scale: int):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("embedding").flatten(), np.float64).reshape(-1, dim)
            y = np.floor(x * scale)
            if len(y) and 4.0 * dim * float(np.abs(y).max(initial=0)) ** 2 >= 2.0 ** 62:
                raise OverflowError("squared distances of these vectors pass 64 bits")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in y.astype(np.int64)], pa.binary())],
                ["vec_id", "label", "v"])
    return run


def _boxes(dim: int):
    """One box of all vectors of a task."""
    def run(batches):
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v").to_pylist(), dim)
                low = v.min(axis=0) if low is None else np.minimum(low, v.min(axis=0))
                high = v.max(axis=0) if high is None else np.maximum(high, v.max(axis=0))
        if low is not None:
            yield pa.record_batch([pa.array(np.arange(dim)), pa.array(low), pa.array(high)], ["k", "low", "high"])
    return run


def _placed(dim: int, parts: int, low: np.ndarray, high: np.ndarray):
    """Each part of each vector with its place on the curve."""
    spans = _spans(dim, parts)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v").to_pylist(), dim)
            for p, (a, b) in enumerate(spans):
                used = min(b - a, HILBERT_BITS)
                bits = max(1, min(16, HILBERT_BITS // max(1, used)))
                width = np.maximum(high[a:a + used] - low[a:a + used] + 1, 1).astype(np.float64)
                cell = np.minimum((v[:, a:a + used] - low[a:a + used]) / width * (1 << bits), (1 << bits) - 1)
                yield pa.record_batch(
                    [pa.array(np.full(len(v), p, np.int32)), pa.array(hilbert(cell, bits)), batch.column("row"), batch.column("row2"),
                     batch.column("copies"), pa.array([r.tobytes() for r in np.ascontiguousarray(v[:, a:b])], pa.binary())],
                    ["part", "place", "row", "row2", "copies", "x"])
    return run


def _block(part: int, rows, x: np.ndarray) -> tuple:
    weight = np.array([r[2] for r in rows], np.int64)
    return (part, len(rows), x.tobytes(), np.array([r[:2] for r in rows], np.int64).tobytes(), weight.tobytes(),
            x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), (x * weight[:, None]).sum(axis=0).tobytes(), int(weight.sum()))


_BLOCKS = ("part int, members int, x binary, rows binary, copies binary, low binary, high binary, sums binary, count long")


def _packed(dim: int, parts: int, block: int):
    """Cut sorted sub-vectors into blocks; no block spans two parts."""
    spans = _spans(dim, parts)
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int64()]
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches):
        part, rows, values, out = None, [], [], []

        def close():
            if rows:
                a, b = spans[part]
                out.append(_block(part, rows, _matrix(values, b - a)))
                rows.clear()
                values.clear()

        def written():
            done = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return done
        for batch in batches:
            for p, row, row2, copies, x in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "row2", "copies", "x"))):
                if p != part or len(rows) == block:
                    close()
                    part = p
                rows.append((row, row2, copies))
                values.append(x)
            if len(out) >= BATCH_BLOCKS:
                yield written()
        close()
        if out:
            yield written()
    return run


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """``listed[block, entry]``: entries that may be nearest to a member of the
    block's box (rows of ``low`` and ``high``), ties included."""
    apart = np.maximum(np.maximum(low[:, None] - entries[None], entries[None] - high[:, None]), 0)
    across = np.maximum(np.abs(low[:, None] - entries[None]), np.abs(high[:, None] - entries[None]))
    least, most = (apart * apart).sum(axis=2), (across * across).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, block: np.ndarray, listed: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each sub-vector among those its block lists, the lower
    of equally near ones, and its squared distance."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    code = np.zeros(len(x), np.int64)
    for e in range(len(entries)):
        at = np.flatnonzero(listed[block, e])
        d = x[at] - entries[e]
        distance = (d * d).sum(axis=1)
        nearer = distance < best[at]
        best[at[nearer]] = distance[nearer]
        code[at[nearer]] = e
    return code, best


def _by_part(batch: pa.RecordBatch):
    parts = batch.column("part").to_numpy()
    for p in np.unique(parts):
        at = np.flatnonzero(parts == p)
        for k in range(0, len(at), BATCH_BLOCKS):
            yield int(p), batch.take(pa.array(at[k:k + BATCH_BLOCKS]))


def _members(some: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = some.column("members").to_numpy()
    block = np.repeat(np.arange(len(count)), count)
    x = np.frombuffer(b"".join(some.column("x").to_pylist()), np.int64).reshape(len(block), width)
    return x, block, np.frombuffer(b"".join(some.column("copies").to_pylist()), np.int64)


def _assigned_sums(spans, books):
    """Sums and counts per part, entry and component over the blocks of a task."""
    def run(batches):
        total = [np.zeros((len(books[p]), b - a), np.int64) for p, (a, b) in enumerate(spans)]
        count = [np.zeros(len(books[p]), np.int64) for p in range(len(spans))]
        for batch in batches:
            for p, some in _by_part(batch):
                width = spans[p][1] - spans[p][0]
                low, high, sums = (_matrix(some.column(c).to_pylist(), width)
                                   for c in ("low", "high", "sums"))
                listed = shortlists(low, high, books[p])
                whole = listed.sum(axis=1) == 1
                to = listed[whole].argmax(axis=1)
                np.add.at(total[p], to, sums[whole])
                np.add.at(count[p], to, some.column("count").to_numpy()[whole])
                open_ = np.flatnonzero(~whole)
                if len(open_):
                    x, block, copies = _members(some.take(pa.array(open_)), width)
                    code, _ = nearest(x, block, listed[open_], books[p])
                    np.add.at(total[p], code, x * copies[:, None])
                    np.add.at(count[p], code, copies)
        rows = [(p, e, k, int(total[p][e, k]) if k < total[p].shape[1] else 0, int(count[p][e]))
                for p in range(len(spans)) for e in np.flatnonzero(count[p]).tolist() for k in range(max(1, total[p].shape[1]))]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["part", "entry", "k", "total", "count"])
    return run


def _codes(spans, books):
    def run(batches):
        for batch in batches:
            for p, some in _by_part(batch):
                width = spans[p][1] - spans[p][0]
                low, high = (_matrix(some.column(c).to_pylist(), width) for c in ("low", "high"))
                x, block, _ = _members(some, width)
                code, distance = nearest(x, block, shortlists(low, high, books[p]), books[p])
                names = np.frombuffer(b"".join(some.column("rows").to_pylist()), np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(np.full(len(code), p, np.int32)),
                                       pa.array(code.astype(np.int32)), pa.array(distance)], ["row", "row2", "part", "code", "distance"])
    return run


def _kept(vectors: DataFrame) -> tuple[DataFrame, int | None]:
    """Sound vectors of the commonest dimension, and that dimension."""
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.coalesce(sound, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not most:
        return rows, None
    return rows.where(F.size("embedding") == most[0]["d"]), most[0]["d"]


def blocks(rows: DataFrame, dim: int, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """The sub-vectors of ``rows`` (``row, row2, copies, v``), in flat blocks."""
    box = {r["k"]: r for r in rows.mapInArrow(_boxes(dim), "k long, low long, high long").groupBy("k").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    low, high = (np.array([box[k][side] for k in range(dim)], np.int64) for side in ("low", "high"))
    placed = rows.mapInArrow(_placed(dim, parts, low, high),
                             "part int, place long, row long, row2 long, copies long, x binary")
    # The row's hashes end the key, so that copies of one vector can be cut apart.
    key = ["part", "place", "row", "row2"]
    return placed.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_packed(dim, parts, block), _BLOCKS)


def learned(block_table: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` rounds, begun with the parts of ``first``."""
    spans = _spans(first.shape[1], parts)
    books = [first[:, a:b].copy() for a, b in spans]
    for _ in range(rounds):
        found = block_table.mapInArrow(_assigned_sums(spans, books), "part long, entry long, k long, total long, count long")
        # A row per part, entry and component reaches the driver.
        whole = F.sum(F.col("total").cast("decimal(38,0)")), F.sum(F.col("count").cast("decimal(38,0)"))
        for r in found.groupBy("part", "entry", "k").agg(whole[0].alias("total"), whole[1].alias("count")).collect():
            if books[r["part"]].shape[1]:
                books[r["part"]][r["entry"], r["k"]] = int(r["total"]) // int(r["count"])
    return books


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
               scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, codes, error)``, one row per kept vector, ``codes`` the
    entry of each part, and the codebooks (none for no vectors)."""
    rows, dim = _kept(vectors)
    if dim is None:
        label = vectors.schema["label"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {label}, codes array<int>, error long"), []
    schema = rows.select("vec_id", "label").schema
    schema = schema.add("v", "binary")
    ints = rows.mapInArrow(_integers(dim, scale), schema).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies"))
    same = [F.col("vec_id"), F.col("vec_id").isNull(), F.col("label"), F.col("label").isNull(), F.col("v")]
    ints = stored(ints.select("*", F.xxhash64(*same).alias("row"), F.xxhash64(F.lit(1), *same).alias("row2")), "code-vectors")
    # At most ``entries`` rows reach the driver; of equal rows, each counts.
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "label", "v").limit(entries).collect()
    first = _matrix([r["v"] for r in first for _ in range(min(r["copies"], entries))][:entries], dim)
    table = stored(blocks(ints.select("row", "row2", "copies", "v"), dim, parts, block), "code-blocks")
    books = learned(table, first, parts, rounds)
    coded = table.mapInArrow(_codes(_spans(dim, parts), books), "row long, row2 long, part int, code int, distance long")
    per_row = coded.groupBy("row", "row2").agg(
        F.array_sort(F.collect_list(F.struct("part", "code"))).alias("c"), F.sum("distance").alias("error"))
    out = ints.select("vec_id", "label", "copies", "row", "row2").join(per_row, ["row", "row2"])
    out = out.select("vec_id", "label", F.col("c.code").alias("codes"), "error",
                     F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.drop("copy"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows of its label (NULLs
    are one label). A label that holds a large share of the rows is joined in
    place."""
    whole = stored(coded.select("*", F.struct(F.col("label").isNull(), F.col("label")).cast("string").alias("of")), "coded")
    sums = stored(whole.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label-errors")
    return hot_key_join(whole, sums.drop("rows"), ["of"], sums.select("of", "rows")).drop("of")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimal."""
    numbers = [str(int(c)) for book in books for entry in book for c in entry]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()
