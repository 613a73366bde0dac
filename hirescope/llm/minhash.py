"""Near-duplicate texts by an inverted join over MinHash coordinates.

1. Every text becomes its set of distinct word shingles; texts with equal sets
   form one class, and classes are compared instead of texts.
2. A class has a signature of ``COORDINATES`` minima. It is posted under its
   (coordinate, value) pairs. Values met once can't collide and fall away.
3. Prefix: two signatures that agree in ``MATCHES`` coordinates share one of
   any ``COORDINATES - MATCHES + 1`` of them, so each class keeps only its
   rarest so many postings. Values of frequent passages are the commonest and
   so are the first to go.
4. Within a posting list collisions are counted over whole signatures, and
   pairs at or above ``MATCHES`` are retained. What they connect is a family.
   No list is expanded into all its pairs: each member first meets one leader
   of its list; then only members of different families are compared, in
   blocks inside tasks, skipping those whose set sizes alone rule a link out,
   and tasks hand on what they joined, not the pairs.
5. Links are confirmed on the full shingle sets. Each set goes to its family
   once; inside the tasks of a family, the most central texts are compared
   first and texts already joined by confirmed links are skipped, so what
   leaves a task is a spanning tree of its links.

A pair at exactly the similarity 0.75 misses the threshold of 32 of 64
coordinates with a probability of about 1e-5; pairs above it less often. No
class, list or pair is capped.

Defined results: NULL, empty or blank text has no shingles and links with
nothing; a row without doc_id links with nothing and has no component; rows
equal in doc_id and text get equal results; other columns of the input are
ignored; an empty table gives an empty result.
"""

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import components, lean, row_key, slices, stored

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
COORDINATES = 64
MATCHES = 32
# Members of a posting list that are compared with each other in one task.
BLOCK = 1024

# Words whose hash a task remembers at a time.
CACHE_WORDS = 100_000
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _words() -> _WordHashes:
    return _WordHashes()


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    Words are what stands between blanks, tabs, line and page breaks; A-Z are
    lower-cased. A text of fewer words than a shingle is one shingle.
    """
    # On bytes, lower() and split() know ASCII letters and ASCII blanks only.
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = x * _BASE + h[k:len(h) - n + 1 + k]
        x ^= x >> np.uint64(29)
    return np.unique(_mixed(x))


@functools.cache
def _seeds() -> np.ndarray:
    return _mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _BASE)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum over the set, per coordinate, of a hash of each shingle."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = (shingles[None, at:at + 4096] ^ _seeds()[:, None]) * _M1
        x = (x ^ (x >> np.uint64(32))) * _M2
        out = np.minimum(out, (x >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32)


def _sign(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, classes, signatures = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, words)
                    sizes.append(len(s))
                    classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signatures.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_key"), pa.array(sizes, pa.int64()),
                     pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                    ["doc_id", "row_key", "n_shingles", "class", "signature"])
    return lean(run, _words)


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("family"),
                     pa.array([shingle_set(t, words).tobytes() for t in part.column("text").to_pylist()], pa.binary())],
                    ["id", "family", "shingles"])
    return lean(run, _words)


def _column(batch: pa.RecordBatch, name: str, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype).reshape(-1, width)


def _agreeing(matches: int):
    """Pairs whose signatures agree in enough coordinates."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                agree = (_column(batch, "sig_a", np.uint32, COORDINATES) ==
                         _column(batch, "sig_b", np.uint32, COORDINATES)).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(agree >= matches))
    return lean(run)


def _groups(batches, *key: str):
    """Tables of whole groups; rows come sorted by the key."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows < 2048:
            continue
        columns = np.stack([rest.column(c).to_numpy() for c in key])
        before = np.flatnonzero((columns != columns[:, -1:]).any(axis=0))
        if len(before):
            yield rest.slice(0, int(before[-1]) + 1)
            rest = rest.slice(int(before[-1]) + 1)
    if rest is not None and rest.num_rows:
        yield rest


def _starts(table: pa.Table, *key: str) -> np.ndarray:
    columns = np.stack([table.column(c).to_numpy() for c in key])
    return np.flatnonzero(np.r_[True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)])


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs with the smallest node it is joined to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        before = low.copy()
        np.minimum.at(low, x, before[y])
        np.minimum.at(low, y, before[x])
        low = low[low]
        if (low == before).all():
            break
    other = nodes[low] != nodes
    return nodes[other], nodes[low][other]


def _labels_met(sig, labels, sizes, own, i, j, matches, numerator, denominator):
    """Pairs of labels of which some members agree."""
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    found = [np.empty((0, 2), np.int64)]
    for at in range(0, len(left), 64):
        rows = left[at:at + 64]
        small, large = np.minimum.outer(sizes[rows], sizes[right]), np.maximum.outer(sizes[rows], sizes[right])
        r, c = np.nonzero((labels[rows][:, None] < labels[right][None, :] if i == j else
                           labels[rows][:, None] != labels[right][None, :]) & (denominator * small >= numerator * large))
        for k in range(0, len(r), 65_536):
            x, y = rows[r[k:k + 65_536]], right[c[k:k + 65_536]]
            hit = (sig[x] == sig[y]).sum(axis=1) >= matches
            found.append(np.unique(np.stack([labels[x[hit]], labels[y[hit]]], axis=1), axis=0))
    return np.concatenate(found)


def _compare_lists(matches: int, numerator: int, denominator: int):
    """Count collisions between members of different families of a posting
    list; rows come sorted by (value, i, j), a pair of blocks of that list."""
    def run(batches):
        for t in _groups(batches, "value", "i", "j"):
            i, j, own, labels, sizes = (t.column(c).to_numpy() for c in ("i", "j", "own", "label", "n"))
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            starts = _starts(t, "value", "i", "j")
            met = [np.empty((0, 2), np.int64)]
            for s, e in zip(starts, np.r_[starts[1:], len(own)]):
                if e - s > 1:
                    met.append(_labels_met(sig[s:e], labels[s:e], sizes[s:e], own[s:e], i[s], j[s],
                                           matches, numerator, denominator))
            met = np.concatenate(met)
            if len(met):
                a, b = _joined(met[:, 0], met[:, 1])
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
    return lean(run)


def spanning_links(sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links between positions of ``sets`` that join whatever all links would."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    shingles, local = np.unique(np.concatenate(sets), return_inverse=True)
    uses = np.bincount(local)
    component = np.arange(len(sets))
    out = []
    # A text made of what many others hold is likely to link most of them.
    for x in np.argsort(-np.add.reduceat(uses[local], starts) / sizes, kind="stable"):
        apart = component != component[x]
        if not apart.any():
            break
        mark = np.zeros(len(shingles), np.int64)
        mark[local[starts[x]:starts[x] + sizes[x]]] = 1
        both = np.add.reduceat(mark[local], starts)
        linked = np.flatnonzero(apart & (denominator * both >= numerator * (sizes[x] + sizes - both)))
        if len(linked):
            joined, first = np.unique(component[linked], return_index=True)
            out += [(int(x), int(y)) for y in linked[first]]
            component[np.isin(component, joined)] = component[x]
    return out


def _confirm(numerator: int, denominator: int):
    """Confirmed links, as spanning trees, of each pair of blocks of a family;
    rows come sorted by (family, i, j)."""
    def run(batches):
        for t in _groups(batches, "family", "i", "j"):
            ids, values = t.column("id").to_numpy(), t.column("shingles")
            starts = _starts(t, "family", "i", "j")
            links = []
            for s, e in zip(starts, np.r_[starts[1:], len(ids)]):
                if e - s > 1:
                    sets = [np.frombuffer(values[k].as_py(), np.uint64) for k in range(s, e)]
                    links += [(ids[s + x], ids[s + y]) for x, y in spanning_links(sets, numerator, denominator)]
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
    return lean(run)


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Every row with its set size, set digest (``class``) and signature."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row_key"), "text")
    return rows.mapInArrow(_sign(words), "doc_id long, row_key long, n_shingles long, class binary, signature binary")


def prefix_postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """``(value, id, n)``: each class under its rarest coordinate values, as
    many as two signatures with enough matches must share one of; values met
    once count as the rarest and are left out."""
    prefix = COORDINATES - matches + 1
    # Signatures hold little-endian words; four bytes and the coordinate's
    # number make one value.
    part = F.expr(f"transform(sequence(0, {COORDINATES - 1}), c -> "
                  "shiftleft(cast(c as bigint), 32) + "
                  "cast(conv(hex(substring(signature, c * 4 + 1, 4)), 16, 10) as bigint))")
    posted = classes.select("id", "n", F.explode(part).alias("value"))
    frequent = posted.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(frequent, "value").groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("by_df"))
    room = F.lit(prefix - COORDINATES) + F.size("by_df")
    kept = shared.where(room > 0).select("id", "n", F.explode(F.slice("by_df", F.lit(1), room)).alias("p"))
    return kept.select(F.col("p.value").alias("value"), "id", "n")


def _blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Deal the rows of each group into blocks; each row comes once for every
    pair of blocks ``i <= j`` that holds its ``own``."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", group), F.col("blocks")).cast("int")
    placed = rows.join(sizes, group).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def _families(postings: DataFrame, signatures: DataFrame, matches: int, numerator: int, denominator: int,
              block: int) -> DataFrame:
    """``(id, family)`` of classes joined by pairs with enough matches."""
    fits = f"{denominator} * least(n, m) >= {numerator} * greatest(n, m)"
    leaders = postings.groupBy("value").agg(F.min(F.struct("id", "n")).alias("lead"), F.count(F.lit(1)).alias("members"))
    leaders = leaders.where("members > 1").select("value", F.col("lead.id").alias("lead"), F.col("lead.n").alias("m"))
    met = postings.join(leaders, "value").where(f"id != lead and {fits}")
    pairs = met.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    counted = (pairs.join(signatures.toDF("a", "sig_a"), "a").join(signatures.toDF("b", "sig_b"), "b")
               .mapInArrow(_agreeing(matches), "a long, b long"))
    edges = stored(counted, "agreeing")
    labels = components(edges, name="led").withColumnRenamed("node", "id").withColumnRenamed("component", "label")
    labelled = postings.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = labelled.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    still = labelled.join(mixed.select("value"), "value", "left_semi").join(signatures, "id")
    placed = _blocks(still, "value", block).select("value", "i", "j", "own", "label", "n", "signature")
    more = (placed.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")
            .mapInArrow(_compare_lists(matches, numerator, denominator), "a long, b long"))
    edges = stored(edges.union(more), "family-edges")
    return components(edges, name="families").withColumnRenamed("node", "id").withColumnRenamed("component", "family")


def near_duplicates(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
                    matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """``(doc_id, row_key, n_shingles, component_id, kept)`` for every row of
    ``docs`` (columns ``doc_id``, an integer, and ``text``).

    Texts are linked where ``denominator * |A and B| >= numerator * |A or B|``;
    ``component_id`` is the smallest doc_id a text reaches by links; ``kept``
    is true where that is its own (and where there is no doc_id).
    """
    rows = stored(signed(docs, words), "signed")
    # A class is named by its smallest doc_id. Two classes may claim the same
    # one (rows that repeat a doc_id with other words); they are then linked.
    named = rows.where("n_shingles > 0 and doc_id is not null").groupBy("class").agg(
        F.min(F.struct("doc_id", "row_key")).alias("first"), F.first("n_shingles").alias("n"),
        F.first("signature").alias("signature"))
    classes = stored(named.select(F.col("first.row_key").alias("id"), F.col("first.doc_id").alias("doc_id"),
                                  "class", "n", "signature"), "classes")
    postings = stored(prefix_postings(classes, matches), "postings")
    families = stored(_families(postings, classes.select("id", "signature"), matches, numerator, denominator, block),
                      "families")
    # The families grow with the texts, so they are never broadcast: the plan is
    # the same at every size.
    texts = docs.select(row_key("doc_id", "text").alias("id"), "text").join(families.hint("merge"), "id")
    sets = texts.dropDuplicates(["id"]).select("id", "family", "text").mapInArrow(
        _sets(words), "id long, family long, shingles binary")
    placed = _blocks(stored(sets, "sets"), "family", block).select("family", "i", "j", "id", "shingles")
    links = (placed.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
             .mapInArrow(_confirm(numerator, denominator), "a long, b long"))
    # A doc_id shared by several classes is one document: it links them.
    one = classes.groupBy("doc_id").agg(F.min("id").alias("a"))
    same = classes.join(one, "doc_id").where("id != a").select("a", F.col("id").alias("b"))
    labels = components(links.union(same), name="confirmed")
    grouped = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = grouped.join(smallest, "component").select("class", "component_id")
    # Rows without shingles get a class of their own, so they don't meet in one task.
    keyed = rows.drop("signature").withColumn("class", F.coalesce("class", F.encode(F.col("row_key").cast("string"), "UTF-8")))
    joined = keyed.join(by_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "row_key", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

