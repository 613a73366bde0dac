"""Row generators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_matches(df: DataFrame, keep: list[str], matches: Column, out: str) -> DataFrame:
    """One row per array element; rows whose array is empty or NULL vanish
    (``explode``, not ``explode_outer``)."""
    return df.select(*keep, F.explode(matches).alias(out))
