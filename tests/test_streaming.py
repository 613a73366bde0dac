"""The streaming upkeep of latest postings equals the batch dedup."""

import datetime as dt
import tempfile

from hirescope import plans
from hirescope.sources.schemas import DESCRIPTIONS_RAW
from hirescope.streaming import latest_postings_stream, merge_latest, read_latest, silver_from_latest
from hirescope.streaming.landing import latest_state, with_seen_dates
from tests.fixtures import DESCRIPTIONS, POSTINGS, descriptions_df, postings_df


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_latest_state_equals_window_dedup(spark):
    raw = postings_df(spark)
    assert _rows(with_seen_dates(latest_state(raw))) == _rows(plans.postings_with_dates(raw))


def _run(spark, root, **kw):
    latest_postings_stream(spark, f"{root}/landing", f"{root}/ckpt", f"{root}/latest", buckets=4, **kw).awaitTermination()


def _land(spark, root, rows):
    postings_df(spark, rows).write.mode("append").parquet(f"{root}/landing")


def test_stream_over_two_landings(spark):
    root = tempfile.mkdtemp(prefix="hs-stream-")
    merged = []
    for rows in (POSTINGS[::2], POSTINGS[1::2]):
        _land(spark, root, rows)
        _run(spark, root, after_merge=lambda: merged.append(1))
    assert len(merged) == 2
    assert _rows(read_latest(spark, f"{root}/latest")) == _rows(plans.postings_with_dates(postings_df(spark)))
    _run(spark, root)  # nothing new
    assert _rows(read_latest(spark, f"{root}/latest")) == _rows(plans.postings_with_dates(postings_df(spark)))


def test_only_touched_buckets_are_written(spark):
    import pathlib
    root = tempfile.mkdtemp(prefix="hs-buckets-")
    _land(spark, root, POSTINGS)
    _run(spark, root)
    files = lambda: {str(p) for p in pathlib.Path(f"{root}/latest").rglob("*.parquet")}
    before = files()
    _land(spark, root, [("u1", "Z", None, dt.datetime(2026, 2, 1))])
    _run(spark, root)
    touched = {p.split("bucket=")[1].split("/")[0] for p in files() ^ before}
    assert len(touched) == 1 and files() & before
    assert [r.title for r in read_latest(spark, f"{root}/latest").where("job_url = 'u1'").collect()] == ["Z"]


def test_replayed_batch_changes_nothing(spark):
    root = tempfile.mkdtemp(prefix="hs-replay-")
    rows = with_seen_dates(latest_state(postings_df(spark)))
    for _ in range(2):
        merge_latest(rows, f"{root}/latest", 4)
    assert _rows(read_latest(spark, f"{root}/latest")) == _rows(rows)


def test_late_descriptions_arrive_with_and_without_a_posting(spark):
    root = tempfile.mkdtemp(prefix="hs-stream2-")
    read = lambda: spark.read.schema(DESCRIPTIONS_RAW).parquet(f"{root}/desc")

    def check(postings, descriptions):
        got = silver_from_latest(spark, f"{root}/latest", read)
        assert _rows(got) == _rows(plans.silver_postings(postings_df(spark, postings), descriptions_df(spark, descriptions)))

    _land(spark, root, POSTINGS[:5])
    descriptions_df(spark, DESCRIPTIONS[:2]).write.mode("append").parquet(f"{root}/desc")
    _run(spark, root, state_partitions=4)
    check(POSTINGS[:5], DESCRIPTIONS[:2])
    descriptions_df(spark, DESCRIPTIONS[2:4]).write.mode("append").parquet(f"{root}/desc")
    _run(spark, root)
    check(POSTINGS[:5], DESCRIPTIONS[:4])  # no posting landed since
    descriptions_df(spark, DESCRIPTIONS[4:]).write.mode("append").parquet(f"{root}/desc")
    _land(spark, root, POSTINGS[5:])
    _run(spark, root)
    check(POSTINGS, DESCRIPTIONS)


def test_state_and_window_break_ties_the_same_way(spark):
    ts = dt.datetime(2026, 1, 1, 6)
    rows = [
        ("t1", "A", None, ts), ("t1", None, None, ts), ("t1", "B", None, ts),     # title decides
        ("t2", None, "2026-01-01", ts), ("t2", None, None, ts),                    # posted_date decides
        ("t3", "Z", None, None), ("t3", "Y", None, ts),                            # NULL time ranks last
        ("t4", "Q", None, None), ("t4", "R", None, None),                          # all times NULL
    ]
    raw = postings_df(spark, rows)
    assert _rows(with_seen_dates(latest_state(raw))) == _rows(plans.postings_with_dates(raw))
