"""The salted fan-out join equals a plain left join, hot key or not."""

import pytest
from pyspark.sql import functions as F

from hirescope.operators.joins import fanout_left_join, hot_keys, row_bytes, rows_of_known_keys


def _sorted(df):
    return sorted(tuple(r) for r in df.fillna("<null>").collect())


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame(
        [("hot", "L1"), ("warm", "L2"), ("cold", "L3"), ("none", "L4"), (None, "L5")],
        "k string, lv string")
    hot_rows = [("hot", f"h{i}") for i in range(40)] + [("hot", "dup")] * 10
    right = spark.createDataFrame(
        hot_rows + [("warm", f"w{i}") for i in range(5)] + [("cold", "c0"), (None, "n0"),
                                                             ("orphan", "o0")],
        "k string, rv string")
    return left, right


# Rows are counted as one byte each, so sizes read as rows.
@pytest.mark.parametrize("rows", [1_000_000, 3, 7, 1])
def test_matches_plain_left_join(sides, rows):
    left, right = sides
    got = fanout_left_join(left, right, "k", bytes_per_task=rows, size=F.lit(1))
    want = left.join(right, "k", "left")
    assert got.columns == ["k", "lv", "rv"]
    assert _sorted(got) == _sorted(want)


def test_hot_key_is_split(sides):
    left, right = sides
    hot = {r["k"]: r["__splits"] for r in hot_keys(right, "k", bytes_per_task=10, size=F.lit(1)).collect()}
    assert hot == {"hot": 5}
    # the hot key's right rows spread over all its buckets
    joined = fanout_left_join(left, right, "k", bytes_per_task=10, size=F.lit(1))
    assert joined.where(F.col("k") == "hot").count() == 50


def test_every_hot_key_is_split_by_its_bytes(sides):
    _, right = sides
    few = {r["k"]: r["__splits"] for r in hot_keys(right, "k", bytes_per_task=100, size=F.lit(50)).collect()}
    assert few == {"hot": 25, "warm": 3}


def test_no_job_runs_while_the_join_is_built(spark, sides):
    left, right = sides
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("skew-build", "building only")
    try:
        fanout_left_join(left, right, "k")
        assert not tracker.getJobIdsForGroup("skew-build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_heavy_keys_are_found_by_their_own_bytes(spark):
    """Few long texts outweigh many short ones; keys far beyond what one sketch tracks."""
    rows = ([("long", "x" * 200_000)] * 3 + [("many", "y")] * 3_000 + [(f"k{i}", "z" * 5) for i in range(30_000)]
            + [(None, "n" * 500_000), ("empty", None)])
    right = spark.createDataFrame(rows, "k string, rv string")
    hot = {r["k"]: r["__splits"] for r in hot_keys(right, "k", bytes_per_task=1 << 17).collect()}
    # 3 x 200 KB and 3,000 x (4 + 1 + 16) bytes, against 131,072
    assert hot == {"long": 5}
    exact = right.where("k = 'many'").agg(F.sum(row_bytes(right))).first()[0]
    assert exact == 3_000 * 21
    assert {r["k"]: r["__splits"] for r in hot_keys(right, "k", bytes_per_task=20_000).collect()} == {"long": 31, "many": 4}


def test_unequal_texts_join_as_plainly(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, lv int")
    right = spark.createDataFrame([("a", "x" * n) for n in (1, 5_000, 1, 90_000)] + [("b", "y")] * 300 + [("z", "z" * 9_000)],
                                  "k string, rv string")
    got = fanout_left_join(left, right, "k", bytes_per_task=2_000, known=left)
    assert _sorted(got) == _sorted(left.join(right, "k", "left"))


def test_unknown_keys_are_dropped_before_the_shuffle(spark):
    known = spark.createDataFrame([(f"u{i}",) for i in range(2_000)] * 2 + [(None,)], "k string")
    right = spark.createDataFrame([(f"u{i}", f"t{i}") for i in range(4_000)] + [(None, "n")], "k string, rv string")
    left = {r["k"] for r in rows_of_known_keys(right, known, "k").collect()}
    assert {f"u{i}" for i in range(2_000)} <= left and len(left) < 2_010 and None not in left
    # with far too few bits more rows pass, but none of a known key is lost
    few = {r["k"] for r in rows_of_known_keys(right, known, "k", bits=4096).collect()}
    assert {f"u{i}" for i in range(2_000)} <= few and len(few) < 3_200
    none = spark.createDataFrame([], "k string")
    assert rows_of_known_keys(right, none, "k").count() == 0


def test_half_unknown_texts_halve_the_shuffle(spark, tmp_path):
    """Bytes of the rows that reach the join's shuffle, with half the keys unknown."""
    left = spark.createDataFrame([(f"u{i}", i) for i in range(500)], "k string, lv int")
    right = spark.createDataFrame([(f"u{i % 1000}", "text " * 50) for i in range(5_000)], "k string, rv string")
    weight = lambda df: df.agg(F.sum(row_bytes(df))).first()[0]
    assert weight(rows_of_known_keys(right, left, "k")) < 0.51 * weight(right)
    got = fanout_left_join(left, right, "k", known=left)
    assert _sorted(got) == _sorted(left.join(right, "k", "left"))
