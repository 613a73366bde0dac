"""Posting date parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_posted_date(c: Column | str) -> Column:
    """Try-cast a scraped date string to DATE; anything unparseable is NULL.

    Uses Spark's own string-to-date cast, so the accepted forms are Spark's:
    ``2026-1-5``, ``2026-01``, ``2026`` and ISO date-times parse; relative
    phrases such as ``3 days ago`` and impossible days such as ``2024-02-31``
    give NULL instead of an error, even under ANSI mode.
    """
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("date")
