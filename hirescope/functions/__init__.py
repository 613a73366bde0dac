"""Column-level expressions. Every function returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen."""

from hirescope.functions.dates import parse_posted_date
from hirescope.functions.experience import (
    BAND_ORDER,
    YEARS_PATTERN,
    band_rank,
    experience_band,
    year_strings,
)
from hirescope.functions.noise import NOISE_TERMS, is_signal_keyword
from hirescope.functions.shares import share_pct
from hirescope.functions.text import ngrams, tokens

__all__ = [
    "BAND_ORDER",
    "NOISE_TERMS",
    "YEARS_PATTERN",
    "band_rank",
    "experience_band",
    "is_signal_keyword",
    "parse_posted_date",
    "ngrams",
    "share_pct",
    "tokens",
    "year_strings",
]
