"""Per-key bounds as window aggregates."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seen_bounds(df: DataFrame, key: str, ts: str,
                first: str = "first_seen_at", last: str = "last_seen_at") -> DataFrame:
    """Attach ``min(ts)`` and ``max(ts)`` over each key's rows.

    Both share one unordered key window. Applied right after
    ``latest_per_key`` on the same key, Spark reuses that operator's hash
    partitioning and sort: no extra exchange or sort is planned.
    """
    w = Window.partitionBy(key)
    return df.withColumn(first, F.min(ts).over(w)).withColumn(last, F.max(ts).over(w))
