"""Random small fixtures: the silver and gold models against a plain-Python
brute force of the same semantics."""

import datetime as dt
import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hirescope import plans
from hirescope.functions.experience import YEARS_PATTERN
from tests.fixtures import descriptions_df, postings_df

KEYS = [None, "a", "b", "c", "d", "e"]
TEXTS = [None, "", "3 years", "10+ years", "2-4 years", "25 years", "1 year; 7 years", "no numbers",
         "100 years", "8 - years", "five years"]


@st.composite
def fixtures(draw):
    n = draw(st.integers(0, 12))
    keys = draw(st.lists(st.sampled_from(KEYS), min_size=n, max_size=n))
    # distinct scrape times so the newest row per key is unambiguous
    hours = draw(st.lists(st.integers(0, 500), min_size=n, max_size=n, unique=True))
    titles = draw(st.lists(st.sampled_from(["T1", "T2", None]), min_size=n, max_size=n))
    postings = [(k, t, "2026-01-05", dt.datetime(2026, 1, 1) + dt.timedelta(hours=h))
                for k, t, h in zip(keys, titles, hours)]
    m = draw(st.integers(0, 10))
    descriptions = draw(st.lists(
        st.tuples(st.sampled_from(KEYS + ["zz"]), st.sampled_from(TEXTS), st.sampled_from(["ok", "error", None])),
        min_size=m, max_size=m))
    return postings, descriptions


def _brute(postings, descriptions):
    latest = {}
    for key, title, _, ts in postings:
        if key not in latest or ts > latest[key][1]:
            latest[key] = (title, ts)
    ok = defaultdict(list)
    for key, text, status in descriptions:
        if status == "ok" and key is not None:
            ok[key].append(text)
    silver = []
    for key in latest:
        texts = ok.get(key) if key is not None else None
        silver += [(key, t) for t in texts] if texts else [(key, None)]
    mins = {}
    for key, text in silver:
        if text is None:
            continue
        for m in re.finditer(YEARS_PATTERN, text.lower()):
            v = int(m.group(1))
            if 0 <= v <= 20:
                mins[key] = min(v, mins.get(key, v))
    req = [(key, mins.get(key)) for key, _ in silver]

    def band(y):
        if y is None:
            return "not_specified"
        return "0-2" if y <= 2 else "3-5" if y <= 5 else "5-8" if y <= 8 else "8+"

    counts = Counter(band(y) for _, y in req)
    total = sum(counts.values())
    dist = {b: (c, float((Decimal(100) * c / total).quantize(Decimal("0.1"), ROUND_HALF_UP)))
            for b, c in counts.items()}
    return silver, req, dist


def _key(t):
    return tuple((x is None, str(x)) for x in t)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(fx=fixtures())
def test_models_match_brute_force(spark, fx):
    postings, descriptions = fx
    want_silver, want_req, want_dist = _brute(postings, descriptions)
    silver = plans.silver_postings(postings_df(spark, postings), descriptions_df(spark, descriptions)).cache()
    try:
        got_silver = [(r.job_url, r.description_text) for r in silver.collect()]
        assert sorted(got_silver, key=_key) == sorted(want_silver, key=_key)
        req = plans.experience_requirements(silver)
        got_req = [(r.job_url, r.years_min) for r in req.collect()]
        assert sorted(got_req, key=_key) == sorted(want_req, key=_key)
        got_dist = {r.experience_band: (r.posting_count, float(r.pct))
                    for r in plans.experience_distribution(req).collect()}
        assert got_dist == want_dist
    finally:
        silver.unpersist()


KEYWORDS = [None, "python", "Python", "data", "data ", "c", "r", "k", "our team", "sql", "go"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(KEYWORDS), st.integers(0, 9), st.integers(1, 4)),
                     min_size=0, max_size=12))
def test_keyword_reports_match_brute_force(spark, rows):
    from hirescope.functions.noise import NOISE_TERMS
    from tests.fixtures import DESCRIPTIONS, POSTINGS, snapshots_df
    snaps = [(k, n, dt.date(2026, 1, d)) for k, n, d in rows]
    silver_rows, _, _ = _brute(POSTINGS, DESCRIPTIONS)
    total = len({k for k, t in silver_rows if t is not None and k is not None})

    def pct(n):
        return float((Decimal(100) * n / total).quantize(Decimal("0.1"), ROUND_HALF_UP))

    kept = [(k, n, d) for k, n, d in snaps if k is not None and k not in NOISE_TERMS and len(k) > 1]
    latest = max((d for _, _, d in snaps), default=None)
    want_latest = sorted((k, n, d, pct(n)) for k, n, d in kept if d == latest)
    want_trends = sorted((k, d, n, pct(n)) for k, n, d in kept)

    silver = plans.silver_postings(postings_df(spark), descriptions_df(spark))
    sdf = snapshots_df(spark, snaps)
    got_latest = sorted((r.keyword, r.posting_count, r.snapshot_date, float(r.pct))
                        for r in plans.keyword_latest(sdf, silver).collect())
    got_trends = sorted((r.keyword, r.snapshot_date, r.posting_count, float(r.pct))
                        for r in plans.keyword_trends(sdf, silver).collect())
    assert got_latest == want_latest
    assert got_trends == want_trends
