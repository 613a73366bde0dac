"""Left joins that stay balanced when one key is hot."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A right-side key with more bytes than this is split over several tasks; the
# order of AQE's skew threshold for a partition.
HOT_BYTES_PER_TASK = 512 * 1024 * 1024
# Sketches of heavy keys and the keys each of them tracks.
SKETCHES, TRACKED = 64, 4096
# Bits of the map of known keys, 8 MB of them by default.
KEY_BITS = 1 << 26
_MAP_BITS = 32_768  # of one ``bitmap_construct_agg``

_SALT, _SPLITS, _MATCHED, _AT = "__salt", "__splits", "__matched", "__at"


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's strings, with a little for each column."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in strings), F.lit(8 * len(df.columns)))


def hot_keys(right: DataFrame, key: str, bytes_per_task: int = HOT_BYTES_PER_TASK,
             size: Column | None = None) -> DataFrame:
    """``(key, __splits)`` for every right-side key of more than
    ``bytes_per_task`` by the sum of ``size`` (the rows' own bytes).

    The keys are not counted one by one: each of ``SKETCHES`` mergeable
    heavy-hitter sketches takes a share of the keys, so a map task hands on at
    most ``SKETCHES * TRACKED`` of them, whatever the input. A row counts once
    per unit of bytes begun. A key with more than a ``0.75 * TRACKED``-th of
    its sketch is always found and its weight never understated by more than
    that; splits need no better figure, as the join is right with any.
    """
    size = row_bytes(right) if size is None else size
    unit = max(1, bytes_per_task >> 17)
    weighed = right.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__k"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(size / F.lit(unit))).cast("int"))))
    heavy = weighed.groupBy(F.pmod(F.xxhash64("__k"), F.lit(SKETCHES)).alias("__sketch")).agg(
        F.expr(f"approx_top_k(__k, {TRACKED}, {TRACKED})").alias("__top"))
    found = heavy.select(F.explode("__top").alias("__t")).select(
        F.col("__t.item").alias(key), (F.col("__t.count") * F.lit(unit)).alias("__bytes"))
    return found.where(F.col("__bytes") > bytes_per_task).select(
        key, F.ceil(F.col("__bytes") / F.lit(bytes_per_task)).cast("int").alias(_SPLITS))


def rows_of_known_keys(right: DataFrame, known: DataFrame, key: str, bits: int = KEY_BITS) -> DataFrame:
    """``right`` without most rows whose key is not among ``known``'s, before
    anything is shuffled; no row of a known key is lost, NULL keys go.

    The known keys set one bit each in a map of ``bits`` bits, so what is
    broadcast is at most ``bits / 8`` bytes, however many keys there are. A
    row passes if its key's bit is set: all known keys, and of the others the
    share of bits set (5 percent with 20 known keys per 400 bits). Repeated
    known keys need no dedup.
    """
    mark = "__known"
    return with_known_keys(right, known, key, mark, bits, "inner").where(F.col(mark)).select(*right.columns)


def with_known_keys(rows: DataFrame, known: DataFrame, key: str, mark: str, bits: int = KEY_BITS,
                    how: str = "left") -> DataFrame:
    """``rows`` (NULL keys go) with the column ``mark``: true where the key may be
    among ``known``'s, by the map of ``rows_of_known_keys``, else NULL. An inner
    join drops rows far from any known key at once."""
    # Never NULL, so that Spark needn't work the key out once more to test for it.
    place = F.coalesce(F.pmod(F.xxhash64(key), F.lit(bits)), F.lit(0))
    bucket, at = F.shiftright(place, _MAP_BITS.bit_length() - 1), place.bitwiseAND(_MAP_BITS - 1).cast("int")
    maps = known.where(F.col(key).isNotNull()).select(bucket.alias("__bucket"), at.alias("__bit")).groupBy("__bucket").agg(
        F.expr("bitmap_construct_agg(__bit)").alias("__map"))
    placed = rows.where(F.col(key).isNotNull()).withColumns({"__bucket": bucket, "__bit": at})
    is_set = F.expr("getbit(conv(hex(substring(__map, __bit div 8 + 1, 1)), 16, 10)::int, __bit % 8) = 1")
    return placed.join(F.broadcast(maps), "__bucket", how).select(*rows.columns, F.when(is_set, F.lit(True)).alias(mark))


def fanout_left_join(left: DataFrame, right: DataFrame, key: str, bytes_per_task: int = HOT_BYTES_PER_TASK,
                     size: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` where ``right`` may repeat a key
    many times and one key may hold a large share of ``right``.

    ``known`` is a frame that holds every key of ``left`` (``left`` itself, or
    a cheaper one); with it, rows of ``right`` that can't match are dropped
    before they are salted and shuffled (``rows_of_known_keys``).

    Spark can only split a skewed join partition on the preserved side of a
    left join; here the hot side is ``right``. So a hot key is salted:
    its right rows are dealt round-robin into ``__splits`` buckets and its
    left row is copied once per bucket, and the join runs on
    ``(key, __salt)``. Every (left, right) pair still meets exactly once.

    The hot-key list stays a DataFrame that both sides left-join; Spark sees
    its size at run time, broadcasts it while it is small, and drops both
    joins when no key is hot. No job runs while the plan is built.

    A copied left row whose bucket happens to be empty would come back
    NULL-extended; since a hot key always has right rows, such rows are
    dropped, which keeps the result identical to the plain left join.
    Cold keys use salt 0 and a single copy, so their NULL-extension
    (no description) is kept as usual. NULL keys never match.

    The bucket is the row's position in its input partition, not a hash of
    its content, so a group of identical copies is spread as well. Positions
    are reproducible when ``right`` is a file scan (as the raw descriptions
    are), so a retried task deals the same buckets; a ``right`` that comes
    straight out of a shuffle should be ``sortWithinPartitions``-ed first.
    """
    if known is not None:
        right = rows_of_known_keys(right, known, key)
    hot = hot_keys(right, key, bytes_per_task, size)
    right_cols = [c for c in right.columns if c != key]
    salted_right = (
        right.withColumn(_AT, F.monotonically_increasing_id())
        .where(F.col(key).isNotNull())
        .join(hot, key, "left")
        .withColumn(_SALT, F.pmod(F.col(_AT), F.coalesce(F.col(_SPLITS), F.lit(1))).cast("int"))
        .withColumn(_MATCHED, F.lit(True))
        .drop(_SPLITS, _AT)
    )
    copied_left = left.join(hot, key, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SPLITS), F.lit(1)) - 1))
    )
    joined = copied_left.join(salted_right, [key, _SALT], "left")
    exact = joined.where(F.col(_SPLITS).isNull() | F.col(_MATCHED).isNotNull())
    return exact.select(*left.columns, *right_cols)


def lookup_left_join(left: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``left LEFT JOIN lookup USING (key)`` where ``lookup`` has at most one
    row per key (an aggregate output). Skew can only sit on ``left``, the
    preserved side, which AQE's skew-join handling may split."""
    return left.join(lookup, key, "left")
