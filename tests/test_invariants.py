"""Invariants over the bound test tables."""

import pytest
from pyspark.sql import functions as F

from hirescope import plans
from hirescope.functions.noise import NOISE_TERMS
from hirescope.sources import bindings

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def models(spark):
    raw = bindings.postings_raw(spark, SF)
    silver = plans.silver_postings(raw, bindings.descriptions_raw(spark, SF)).cache()
    req = plans.experience_requirements(silver).cache()
    snaps = bindings.keyword_snapshots(spark, SF).cache()
    yield raw, silver, req, snaps
    for df in (silver, req, snaps):
        df.unpersist()


def test_silver_covers_every_key(models):
    raw, silver, _, _ = models
    keys = raw.select("job_url").distinct().count()  # NULL counts as one key
    assert silver.select("job_url").distinct().count() == keys
    assert silver.count() >= keys


def test_requirements_one_row_per_silver_row(models):
    _, silver, req, _ = models
    assert req.count() == silver.count()


def test_distribution_sums_to_requirements(models):
    _, _, req, _ = models
    dist = plans.experience_distribution(req)
    assert dist.agg(F.sum("posting_count")).first()[0] == req.count()


def test_latest_equals_trends_at_latest_date(models):
    _, silver, _, snaps = models
    latest = plans.keyword_latest(snaps, silver)
    trends = plans.keyword_trends(snaps, silver)
    day = snaps.agg(F.max("snapshot_date")).first()[0]
    a = sorted(map(tuple, latest.select("keyword", "snapshot_date", "posting_count", "pct").collect()))
    b = sorted(map(tuple, trends.where(F.col("snapshot_date") == day).collect()))
    assert a == b


def test_described_total_needs_no_silver(spark, models):
    raw, silver, _, _ = models
    got = plans.described_postings(raw, bindings.descriptions_raw(spark, SF)).first()[0]
    assert got == plans.described_total(silver).first()[0]


def test_text_columns_hold_distinct_values(models):
    _, silver, _, _ = models
    r = silver.agg(*[F.countDistinct(c).alias(c) for c in ("company", "location", "search_keyword", "search_location")]).first()
    assert r.company > 1 and r.location > 1 and r.search_keyword > 1 and r.search_location > 1


def test_no_noise_in_output(models):
    _, silver, _, snaps = models
    out = plans.keyword_trends(snaps, silver)
    assert out.where(F.col("keyword").isin(list(NOISE_TERMS))).count() == 0


def test_salted_join_equals_plain_join_on_bound_tables(spark, models):
    from hirescope.operators.joins import fanout_left_join
    raw, _, _, _ = models
    posts = plans.postings_with_dates(raw)
    desc = plans.ok_descriptions(bindings.descriptions_raw(spark, SF))
    # a tiny per-task budget forces every key with more than 3 rows to be split
    got = fanout_left_join(posts, desc, "job_url", bytes_per_task=3, size=F.lit(1), known=posts)
    want = posts.join(desc, "job_url", "left")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
