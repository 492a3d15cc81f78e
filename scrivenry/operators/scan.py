"""Ordered scans with a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, key: str, after: str | None = None, size: int = 500) -> DataFrame:
    """The next ``size`` rows by a unique key after the cursor; rows without a key end the scan."""
    left = rows.where(F.col(key).isNotNull())
    if after is not None:
        left = left.where(F.col(key) > after)
    return left.orderBy(key).limit(size)
