"""Silver models: one clean row per posting, and the minimum years asked."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirescope.functions.dates import parse_posted_date
from hirescope.functions.experience import YEARS_MAX_VALID, YEARS_MIN_VALID, year_strings
from hirescope.operators.aggregates import min_per_key
from hirescope.operators.dedup import latest_per_key
from hirescope.operators.generators import explode_matches
from hirescope.operators.joins import fanout_left_join, lookup_left_join
from hirescope.operators.windows import seen_bounds

KEY = "job_url"
POSTING_COLS = ["job_url", "title", "company", "location", "posted_date",
                "search_keyword", "search_location"]
SILVER_COLS = POSTING_COLS + ["first_seen_at", "last_seen_at", "description_text"]


def postings_latest(postings_raw: DataFrame) -> DataFrame:
    """The newest scrape of each posting (all NULL URLs count as one posting)."""
    return latest_per_key(postings_raw.select(*POSTING_COLS, "scraped_at"), KEY, "scraped_at")


def postings_with_dates(postings_raw: DataFrame) -> DataFrame:
    """Latest scrape, posted date parsed, first/last seen attached.

    The seen-bounds window runs after the dedup, over one row per key, so
    both bounds equal that row's ``scraped_at``. That is the source model's
    behaviour and is kept.
    """
    latest = postings_latest(postings_raw)
    bounded = seen_bounds(latest, KEY, "scraped_at")
    return bounded.select(
        "job_url", "title", "company", "location",
        parse_posted_date("posted_date").alias("posted_date"),
        "search_keyword", "search_location", "first_seen_at", "last_seen_at",
    )


def ok_descriptions(descriptions_raw: DataFrame) -> DataFrame:
    """Descriptions fetched with status exactly ``'ok'`` (NULL status drops out).
    Not deduplicated: two ``ok`` rows for a key both join."""
    return descriptions_raw.where(F.col("fetch_status") == "ok").select(KEY, "description_text")


def silver_postings(postings_raw: DataFrame, descriptions_raw: DataFrame, **split) -> DataFrame:
    """M1: one row per posting, more when several ``ok`` descriptions match.

    ``split`` (``bytes_per_task``) sets from which size the descriptions of
    one posting are joined by several tasks.
    """
    return with_descriptions(postings_with_dates(postings_raw), descriptions_raw, known=postings_raw, **split)


def with_descriptions(postings: DataFrame, descriptions_raw: DataFrame, known: DataFrame | None = None,
                      **split) -> DataFrame:
    """Latest postings joined to their ``ok`` descriptions. Texts of postings
    that are not in ``known`` (the raw scrapes, whose key column is all that is
    read for it; ``postings`` if not given) are dropped before any shuffle."""
    known = (postings if known is None else known).select(KEY)
    joined = fanout_left_join(postings, ok_descriptions(descriptions_raw), KEY, known=known, **split)
    return joined.select(*SILVER_COLS)


def year_mentions(silver: DataFrame) -> DataFrame:
    """Every years-pattern mention in every non-NULL description, as an int.

    The regex runs over the whole lower-cased text; each match becomes a row.
    """
    described = silver.where(F.col("description_text").isNotNull())
    exploded = explode_matches(described, [KEY], year_strings("description_text"), "years_str")
    return exploded.where(F.col("years_str").isNotNull() & (F.col("years_str") != "")).select(
        KEY, F.col("years_str").cast("int").alias("years_val")
    )


def min_years_per_posting(silver: DataFrame) -> DataFrame:
    """Smallest valid mention per posting key, over all its descriptions."""
    valid = year_mentions(silver).where(F.col("years_val").between(YEARS_MIN_VALID, YEARS_MAX_VALID))
    return min_per_key(valid, KEY, "years_val", "years_min")


def experience_requirements(silver: DataFrame) -> DataFrame:
    """M2: one row per silver row with the posting's minimum years (or NULL).

    ``silver`` is read twice (its keys, and its descriptions for the
    mentions), so pass the stored table (``build_all`` does, and
    ``sources.sinks.stage`` makes one): an unstored silver plan would
    deduplicate the raw scrape twice.
    """
    return lookup_left_join(silver.select(KEY), min_years_per_posting(silver), KEY).select(
        KEY, "years_min"
    )
