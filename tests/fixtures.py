"""Hand-written edge fixture (FIXTURES.md section 2)."""

import datetime as dt

from hirescope.sources.schemas import DESCRIPTIONS_RAW, KEYWORD_SNAPSHOTS, POSTINGS_RAW


def _ts(day, hour):
    return dt.datetime(2026, 1, day, hour, 0)


POSTINGS = [
    # job_url, title, posted_date, scraped_at
    ("u1", "A", "2025-12-30", _ts(1, 0)),
    ("u1", "B", "2025-12-30", _ts(1, 6)),
    ("u1", "C", "2025-12-30", _ts(1, 12)),
    ("u2", "D", "2 weeks ago", _ts(1, 0)),
    ("u3", "E", "2026-01", _ts(1, 0)),
    (None, "F", None, _ts(1, 0)),
    (None, "G", None, _ts(1, 6)),
    ("u4", "H", None, _ts(1, 0)),
    ("u5", "I", "2026-01-03", _ts(1, 0)),
    ("u6", "J", "2026-01-03", _ts(1, 0)),
]

DESCRIPTIONS = [
    ("u1", "Requires 2-3 years", "ok"),
    ("u2", None, "ok"),
    ("u3", "100 years heritage; 10+ YEARS", "ok"),
    ("u5", "9 years", "error"),
    ("u6", "5 years", "ok"),
    ("u6", "3+ years", "ok"),
    (None, "4 years", "ok"),
]

SNAPSHOTS = [
    ("python", 2, dt.date(2026, 1, 1)),
    ("sql", 1, dt.date(2026, 1, 1)),
    ("python", 3, dt.date(2026, 1, 2)),
    ("data", 3, dt.date(2026, 1, 2)),
    ("Data", 1, dt.date(2026, 1, 2)),
    ("c", 1, dt.date(2026, 1, 2)),
    (None, 1, dt.date(2026, 1, 2)),
]


def postings_df(spark, rows=POSTINGS):
    # Each text column names itself, so two that change places are noticed.
    full = [(u, t, f"company of {t}", f"location of {t}", p, f"keyword of {t}", f"area of {t}", s) for (u, t, p, s) in rows]
    return spark.createDataFrame(full, POSTINGS_RAW)


def descriptions_df(spark, rows=DESCRIPTIONS):
    return spark.createDataFrame([(u, t, s) for (u, t, s) in rows], DESCRIPTIONS_RAW)


def snapshots_df(spark, rows=SNAPSHOTS):
    return spark.createDataFrame(rows, KEYWORD_SNAPSHOTS)
