"""Keep the newest row per key."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RN = "__rn"


def latest_per_key(df: DataFrame, key: str, order_col: str,
                   tie_break: Sequence[str] | None = None) -> DataFrame:
    """One row per ``key`` (NULL keys form one group): the row with the
    greatest ``order_col``; NULL ``order_col`` ranks last.

    ``row_number() = 1`` over a key window is planned by Spark as a
    ``WindowGroupLimit``: a partial top-1 runs inside every map task before
    the shuffle, so a hot key (or the NULL key) ships at most one row per
    map task and cannot skew the exchange.

    Ties on ``order_col`` are broken by ``tie_break`` (default: every other
    column, descending). A total order makes the choice reproducible, so a
    stage recomputed after a lost executor picks the same row.
    """
    if tie_break is None:
        tie_break = [c for c in df.columns if c not in (key, order_col)]
    order = [F.col(order_col).desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in tie_break]
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)
