"""Aggregates: per-key minimum, exact distinct totals, grouped shares."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirescope.functions.shares import share_pct


def min_per_key(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``min(value)`` per key. Partial aggregation runs before the shuffle,
    so a hot key is reduced to one row per map task."""
    return df.groupBy(key).agg(F.min(value).alias(out))


def distinct_count(df: DataFrame, col: str, out: str) -> DataFrame:
    """One-row frame with the exact number of distinct non-NULL ``col``
    values. Spark plans a two-level aggregate (dedupe per key, then count),
    so no task ever holds more than its share of the keys."""
    return df.agg(F.countDistinct(col).alias(out))


def max_value(df: DataFrame, col: str, out: str) -> DataFrame:
    """One-row frame with ``max(col)``."""
    return df.agg(F.max(col).alias(out))


def count_share_by(df: DataFrame, group: Column, group_name: str,
                   count_name: str = "posting_count", pct_name: str = "pct") -> DataFrame:
    """Rows per group and each group's share of all rows.

    The grand total is the sum of the per-group counts, taken by a window
    over the already-aggregated frame. That saves a second pass over the
    input; it is only safe when the number of groups is bounded by
    construction (a handful of CASE labels), because the un-partitioned
    window runs in one task.
    """
    counts = df.groupBy(group.alias(group_name)).agg(F.count(F.lit(1)).alias(count_name))
    total = F.sum(count_name).over(Window.partitionBy())
    return counts.withColumn(pct_name, share_pct(F.col(count_name), total))

