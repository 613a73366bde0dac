"""The described total kept from part to part, against a count in plain Python."""

import random

import pytest

from hirescope import plans
from hirescope.plans.totals import keep_described, kept_described_total

POSTED, DESCRIBED = "job_url string", "job_url string, fetch_status string, description_text string"


def _frames(spark, posted, described):
    return spark.createDataFrame([(k,) for k in posted], POSTED), spark.createDataFrame(described, DESCRIBED)


def _count(parts):
    ok = {k for _, d in parts for k, status, text in d if status == "ok" and text is not None}
    return len(({k for p, _ in parts for k in p} & ok) - {None})


def _total(spark, state):
    row = kept_described_total(spark, state).collect()
    assert len(row) == 1
    return row[0]["total_postings"]


@pytest.mark.parametrize("buckets", [1, 5])
def test_total_follows_every_part(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    key = lambda: rng.choice([None, *[f"job/{i}" for i in range(60)]])
    parts, state = [], str(tmp_path / "state")
    for n in range(4):
        part = ([key() for _ in range(25)],
                [(key(), rng.choice(["ok", "ok", "gone", None]), rng.choice(["text", "", None])) for _ in range(30)])
        parts.append(part)
        # The number of shares may change from one run to the next.
        keep_described(state, f"day {n}/x", *_frames(spark, *part), buckets=buckets + n)
        assert _total(spark, state) == _count(parts)
    keys = spark.read.parquet(f"{state}/keys").collect()
    assert len({r["job_url"] for r in keys}) == len({r["key_id"] for r in keys}) == len(keys)


def test_a_part_added_again_replaces_its_bits_and_may_be_empty(spark, tmp_path):
    state = str(tmp_path / "state")
    first = (["a", "b", "b", None], [("a", "ok", "x"), ("a", "ok", "x"), ("c", "ok", "x"), (None, "ok", "x")])
    keep_described(state, "1", *_frames(spark, [], []))
    assert _total(spark, state) == 0
    for _ in range(2):
        keep_described(state, "1", *_frames(spark, *first))
        assert _total(spark, state) == 1
    # A posting scraped only after its description came.
    keep_described(state, "2", *_frames(spark, ["c"], []))
    assert _total(spark, state) == 2
    keep_described(state, "1", *_frames(spark, [], []))
    assert _total(spark, state) == 0


def test_a_run_that_failed_between_keys_and_bits_is_mended_by_the_next(spark, tmp_path):
    state, frames = str(tmp_path / "state"), _frames(spark, ["a", "b"], [("a", "ok", "x"), ("b", "ok", "x")])
    spark.createDataFrame([("a", 1)], "job_url string, key_id long").write.parquet(f"{state}/keys")
    keep_described(state, "1", *frames, buckets=1)
    assert _total(spark, state) == 2
    assert sorted(map(tuple, spark.read.parquet(f"{state}/keys").collect())) == [("a", 1), ("b", 2)]


def test_pages_of_many_keys_and_only_bits_are_read(spark, tmp_path):
    state = str(tmp_path / "state")
    keys = spark.range(100_000).selectExpr("concat('job/', id) AS job_url")
    texts = spark.range(0, 150_000, 3).selectExpr("concat('job/', id) AS job_url", "'ok' AS fetch_status", "'x' AS description_text")
    keep_described(state, "1", keys, texts, buckets=2)
    out = kept_described_total(spark, state)
    assert out.first()[0] == 33_334
    assert out.inputFiles() and all(f"{state}/bits/" in f for f in out.inputFiles())
    # The reports take the kept total in place of the count.
    rows = spark.sql("SELECT 'spark' AS keyword, 16667L AS posting_count, DATE'2024-01-01' AS snapshot_date")
    assert float(plans.keyword_trends(rows, None, total=out).first()["pct"]) == 50.0
