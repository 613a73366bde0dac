"""The models: silver (clean) and gold (report) tables, the keyword snapshot job."""

from hirescope.plans.gold import (
    described_postings,
    described_total,
    experience_distribution,
    keyword_latest,
    keyword_trends,
    latest_snapshot_date,
    signal_keywords,
    store_trends,
    stored_trends,
)
from hirescope.plans.project import build_all
from hirescope.plans.snapshots import (
    changed_postings,
    keyword_snapshot,
    keyword_snapshot_after,
    posting_digests,
)
from hirescope.plans.silver import (
    experience_requirements,
    ok_descriptions,
    postings_latest,
    postings_with_dates,
    silver_postings,
    with_descriptions,
    year_mentions,
    min_years_per_posting,
)
from hirescope.plans.totals import keep_described, kept_described_total

__all__ = [
    "build_all",
    "changed_postings",
    "described_postings",
    "described_total",
    "experience_distribution",
    "experience_requirements",
    "keep_described",
    "kept_described_total",
    "keyword_latest",
    "keyword_snapshot",
    "keyword_snapshot_after",
    "keyword_trends",
    "latest_snapshot_date",
    "min_years_per_posting",
    "ok_descriptions",
    "posting_digests",
    "postings_latest",
    "postings_with_dates",
    "signal_keywords",
    "silver_postings",
    "store_trends",
    "stored_trends",
    "with_descriptions",
    "year_mentions",
]
