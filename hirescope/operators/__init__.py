"""DataFrame -> DataFrame building blocks used by the models."""

from hirescope.operators.aggregates import (
    count_share_by,
    distinct_count,
    max_value,
    min_per_key,
)
from hirescope.operators.dedup import latest_per_key
from hirescope.operators.generators import explode_matches
from hirescope.operators.joins import fanout_left_join, lookup_left_join
from hirescope.operators.windows import seen_bounds

__all__ = [
    "count_share_by",
    "distinct_count",
    "explode_matches",
    "fanout_left_join",
    "latest_per_key",
    "lookup_left_join",
    "max_value",
    "min_per_key",
    "seen_bounds",
]
