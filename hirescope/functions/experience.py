"""Years-of-experience extraction and banding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the source models exactly.
# Years pattern, applied to lower-cased text; group 1 is the number.
YEARS_PATTERN = r"([0-9]{1,2})[ -]*[+]?[ ]*years?"
# Mentions outside this closed range are ignored.
YEARS_MIN_VALID = 0
YEARS_MAX_VALID = 20
# Band labels, in report order, with their inclusive upper bounds.
# Note the third label reads "5-8" although it holds 6, 7 and 8.
BAND_ORDER = ("0-2", "3-5", "5-8", "8+", "not_specified")
BAND_UPPER = (("0-2", 2), ("3-5", 5), ("5-8", 8))
BAND_OPEN = "8+"
BAND_MISSING = "not_specified"


# The pattern above as given to Java's backtracking engine. Written as is,
# "[ -]*" then "[ ]*" split every run of blanks both ways: a number followed
# by a long blank run that does not end in "year" costs time quadratic in the
# run (minutes for one junk description). Making the first run possessive
# keeps every match: right after a maximal run of blanks and hyphens,
# "[+]?" and "[ ]*" can still match (the latter empty), so nothing is ever
# gained by giving characters back. Property tests check Spark's matches
# against Python's engine running the pattern as written.
_YEARS_PATTERN_JAVA = YEARS_PATTERN.replace("[ -]*", "[ -]*+", 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_strings(text: Column | str) -> Column:
    """Array of every number captured by the years pattern in the whole text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(_YEARS_PATTERN_JAVA), F.lit(1))


def experience_band(years: Column | str) -> Column:
    """Searched CASE, first match wins, NULL checked first."""
    years = _col(years)
    expr = F.when(years.isNull(), F.lit(BAND_MISSING))
    for label, upper in BAND_UPPER:
        expr = expr.when(years <= upper, F.lit(label))
    return expr.otherwise(F.lit(BAND_OPEN))


def band_rank(band: Column | str) -> Column:
    """Report position of a band label; unknown labels sort last."""
    band = _col(band)
    expr = None
    for pos, label in enumerate(BAND_ORDER[:-1], start=1):
        expr = F.when(band == label, F.lit(pos)) if expr is None else expr.when(band == label, F.lit(pos))
    return expr.otherwise(F.lit(len(BAND_ORDER)))
