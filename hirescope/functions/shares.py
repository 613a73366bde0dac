"""Percentage shares."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal, not double: ``100.0`` in SQL is decimal(4,1), and the share is
# rounded HALF_UP on the exact decimal quotient.
_HUNDRED = Decimal("100.0")


def share_pct(count: Column | str, total: Column | str) -> Column:
    """``round(100.0 * count / total, 1)`` with SQL decimal semantics.

    A zero total raises DIVIDE_BY_ZERO under ANSI mode, as the SQL would.
    """
    count = F.col(count) if isinstance(count, str) else count
    total = F.col(total) if isinstance(total, str) else total
    return F.round(F.lit(_HUNDRED) * count / total, 1)
