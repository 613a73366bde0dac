"""Edge fixture: every quirk of the source models, with expected rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirescope import plans
from tests.fixtures import descriptions_df, postings_df, snapshots_df


@pytest.fixture(scope="module")
def silver(spark):
    df = plans.silver_postings(postings_df(spark), descriptions_df(spark)).cache()
    yield df
    df.unpersist()


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def test_silver_rows(silver):
    rows = silver.collect()
    assert len(rows) == 8
    by_key = {}
    for r in rows:
        by_key.setdefault(r.job_url, []).append(r)
    # all NULL URLs collapse to one posting: the newest (G), no description
    (null_row,) = by_key[None]
    assert null_row.title == "G" and null_row.description_text is None
    assert null_row.first_seen_at == null_row.last_seen_at == dt.datetime(2026, 1, 1, 6)
    # first_seen_at equals last_seen_at: the windows run after the dedup
    (u1,) = by_key["u1"]
    assert u1.title == "C"
    assert u1.first_seen_at == u1.last_seen_at == dt.datetime(2026, 1, 1, 12)
    assert u1.posted_date == dt.date(2025, 12, 30)
    assert by_key["u2"][0].posted_date is None
    assert by_key["u3"][0].posted_date == dt.date(2026, 1, 1)
    assert by_key["u4"][0].description_text is None
    assert by_key["u5"][0].description_text is None  # status 'error'
    assert sorted(r.description_text for r in by_key["u6"]) == ["3+ years", "5 years"]
    assert silver.columns == ["job_url", "title", "company", "location", "posted_date",
                              "search_keyword", "search_location", "first_seen_at",
                              "last_seen_at", "description_text"]


def test_experience_requirements(silver):
    req = plans.experience_requirements(silver)
    assert _rows(req, "job_url", "years_min") == sorted(
        [(None, None), ("u1", 3), ("u2", None), ("u3", 0), ("u4", None), ("u5", None),
         ("u6", 3), ("u6", 3)],
        key=lambda t: tuple((x is None, str(x)) for x in t))


def test_experience_distribution(silver):
    dist = plans.experience_distribution(plans.experience_requirements(silver))
    got = [(r.experience_band, r.posting_count, float(r.pct)) for r in dist.collect()]
    assert got == [("0-2", 1, 12.5), ("3-5", 3, 37.5), ("not_specified", 4, 50.0)]


def test_described_total(silver):
    assert plans.described_total(silver).collect()[0].total_postings == 3


def test_keyword_latest(spark, silver):
    out = plans.keyword_latest(snapshots_df(spark), silver)
    got = [(r.keyword, r.posting_count, r.snapshot_date, float(r.pct)) for r in out.collect()]
    assert got == [("python", 3, dt.date(2026, 1, 2), 100.0), ("Data", 1, dt.date(2026, 1, 2), 33.3)]
    assert out.columns == ["keyword", "posting_count", "snapshot_date", "pct"]


def test_keyword_trends(spark, silver):
    out = plans.keyword_trends(snapshots_df(spark), silver)
    got = [(r.keyword, r.snapshot_date, r.posting_count, float(r.pct)) for r in out.collect()]
    assert got == [
        ("python", dt.date(2026, 1, 1), 2, 66.7),
        ("sql", dt.date(2026, 1, 1), 1, 33.3),
        ("python", dt.date(2026, 1, 2), 3, 100.0),
        ("Data", dt.date(2026, 1, 2), 1, 33.3),
    ]
    assert out.columns == ["keyword", "snapshot_date", "posting_count", "pct"]


def test_pct_is_decimal_one_place(silver):
    dist = plans.experience_distribution(plans.experience_requirements(silver))
    t = dict(dist.dtypes)["pct"]
    assert t.startswith("decimal(") and t.endswith(",1)")


def test_latest_date_taken_before_noise(spark, silver):
    snaps = snapshots_df(spark).union(
        spark.createDataFrame([("data", 9, dt.date(2026, 1, 3))], snapshots_df(spark).schema))
    assert plans.keyword_latest(snaps, silver).count() == 0


def test_zero_described_postings_raises(spark):
    from pyspark.errors import ArithmeticException
    empty_desc = descriptions_df(spark, [])
    silver = plans.silver_postings(postings_df(spark), empty_desc)
    with pytest.raises(ArithmeticException, match="DIVIDE_BY_ZERO"):
        plans.keyword_latest(snapshots_df(spark), silver).collect()


def test_empty_input_gives_no_bands(spark):
    silver = plans.silver_postings(postings_df(spark, []), descriptions_df(spark, []))
    assert plans.experience_distribution(plans.experience_requirements(silver)).count() == 0


def test_noise_is_case_sensitive(spark):
    from hirescope.functions.noise import is_signal_keyword
    df = spark.createDataFrame([("data",), ("Data",), ("data ",), (None,), ("r",), ("k",), ("go",)], "keyword string")
    kept = sorted(r.keyword for r in df.where(is_signal_keyword("keyword")).collect())
    assert kept == ["Data", "data ", "go"]


@pytest.mark.parametrize("text,expected", [
    ("2-3 years", ["3"]), ("3 to 5 years", ["5"]), ("100 years", ["00"]), ("2024 years", ["24"]),
    ("1.5 years", ["5"]), ("2 yearly", ["2"]), ("5 - years", ["5"]), ("5-year", ["5"]),
    ("10 + years", ["10"]), ("five years", []), ("5 yrs", []), ("3 or more years", []),
    ("5+-years", []), ("5\nyears", []), ("5 years", []), ("10+ YEARS", ["10"]),
])
def test_years_pattern(spark, text, expected):
    from hirescope.functions.experience import year_strings
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(year_strings("t").alias("m")).collect()[0].m == expected


@pytest.mark.parametrize("text,expected", [
    ("2026-1-5", dt.date(2026, 1, 5)), ("2026-01", dt.date(2026, 1, 1)), ("2026", dt.date(2026, 1, 1)),
    (" 2026-01-05 ", dt.date(2026, 1, 5)), ("2026-01-05T10:00:00", dt.date(2026, 1, 5)),
    ("05/01/2026", None), ("2026/01/05", None), ("20260105", None), ("2026-02-30", None),
])
def test_posted_date_parse(spark, text, expected):
    from hirescope.functions.dates import parse_posted_date
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_posted_date("t").alias("d")).collect()[0].d == expected


def test_q2_ties_pick_the_same_row_every_time(spark):
    ts = dt.datetime(2026, 1, 1, 6)
    rows = [("t1", "A", None, ts), ("t1", "B", None, ts), ("t1", "C", None, None)]
    for _ in range(3):
        out = plans.postings_latest(postings_df(spark, rows).repartition(3)).collect()
        assert [(r.job_url, r.title) for r in out] == [("t1", "B")]  # NULL time ranks last


def test_q5_null_or_other_status_drops_description_not_posting(spark):
    desc = descriptions_df(spark, [("u4", "3 years", None), ("u4", "4 years", "OK"), ("u4", "5 years", "ok ")])
    silver = plans.silver_postings(postings_df(spark), desc)
    u4 = silver.where(F.col("job_url") == "u4").collect()
    assert len(u4) == 1 and u4[0].description_text is None


def test_q8_values_over_20_are_ignored(spark):
    desc = descriptions_df(spark, [("u4", "25 years; 21 years", "ok"), ("u2", "25 years, 20 years", "ok")])
    req = plans.experience_requirements(plans.silver_postings(postings_df(spark), desc))
    got = {r.job_url: r.years_min for r in req.where(F.col("job_url").isin("u2", "u4")).collect()}
    assert got == {"u2": 20, "u4": None}


def test_q11_band_labels(spark):
    from hirescope.functions.experience import experience_band
    vals = [0, 2, 3, 5, 6, 8, 9, 20, None]
    df = spark.createDataFrame([(v,) for v in vals], "y int")
    got = [r.b for r in df.select(experience_band("y").alias("b")).collect()]
    assert got == ["0-2", "0-2", "3-5", "3-5", "5-8", "5-8", "8+", "8+", "not_specified"]


def test_q13_share_can_exceed_100(spark, silver):
    snaps = snapshots_df(spark, [("rust", 7, dt.date(2026, 1, 5))])
    (row,) = plans.keyword_latest(snaps, silver).collect()
    assert float(row.pct) == 233.3  # 7 of 3 described postings


def test_q18_duplicate_snapshot_rows_pass_through(spark, silver):
    d = dt.date(2026, 1, 5)
    snaps = snapshots_df(spark, [("rust", 1, d), ("rust", 1, d)])
    assert plans.keyword_trends(snaps, silver).count() == 2
    assert plans.keyword_latest(snaps, silver).count() == 2


def test_precomputed_total_gives_identical_reports(spark, silver):
    snaps = snapshots_df(spark)
    for fn in (plans.keyword_latest, plans.keyword_trends):
        a, b = fn(snaps, silver), fn(snaps, silver, total=3)
        assert a.dtypes == b.dtypes
        assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]


def test_precomputed_zero_total_still_raises(spark, silver):
    from pyspark.errors import ArithmeticException
    with pytest.raises(ArithmeticException, match="DIVIDE_BY_ZERO"):
        plans.keyword_trends(snapshots_df(spark), silver, total=0).collect()
