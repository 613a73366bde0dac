"""Keyword noise filter."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the source stop list exactly (70 terms).
# Legal, benefits and other posting boilerplate:
BOILERPLATE_TERMS = (
    "equal opportunity employer", "equal", "privacy", "employees",
    "employee", "employer", "benefits", "compensation", "salary",
    "factors", "security", "compliance", "policy", "applicants",
    "bonus", "pto", "vision", "health", "medical", "dental", "our customers",
    "best practices", "impact", "life", "analytics", "your work", "basis",
)
# Generic structural and role words:
GENERIC_TERMS = (
    "range", "end", "scale", "engineers", "engineer", "software",
    "science", "engineering", "data", "world", "computer science",
    "computer", "design", "platform", "infrastructure", "reliability",
    "build", "tools", "development", "code", "future", "location",
    "partner", "performance", "person", "customers", "office",
    "our team", "our mission", "equity", "systems", "technology",
    "production", "business", "access", "training", "preferred",
    "senior", "time", "strong", "familiarity", "bachelor", "k",
)
NOISE_TERMS = BOILERPLATE_TERMS + GENERIC_TERMS

# Keywords must be longer than this many characters.
MIN_KEYWORD_LENGTH = 1


def _named(keyword: Column | str) -> Column:
    return F.col(keyword) if isinstance(keyword, str) else keyword


def is_long_enough(keyword: Column | str) -> Column:
    """More than one character; NULL for a NULL keyword, which a filter drops."""
    return F.length(_named(keyword)) > MIN_KEYWORD_LENGTH


def is_signal_keyword(keyword: Column | str, noise=NOISE_TERMS) -> Column:
    """Keep a keyword unless it is a noise term or too short.

    Exact, case-sensitive match like SQL ``NOT IN``: a NULL keyword is
    dropped, ``Data`` and ``data `` survive. The list is a literal, so
    Catalyst turns it into ``INSET`` and pushes ``Not(In(..))`` to Parquet.
    """
    return (~_named(keyword).isin(list(noise))) & is_long_enough(keyword)
