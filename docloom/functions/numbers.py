"""Rounding that gives the same digits on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import col


def mean_4dp(value, where: Column | None = None) -> Column:
    """Mean of values that carry four decimals, rounded half up in whole ten-thousandths.

    Adding whole numbers keeps the result independent of the order the partitions arrive in.
    """
    v = F.round(col(value) * 10000).cast("bigint")
    v = F.when(where, v) if where is not None else v
    s, n = F.sum(v), F.count(v)
    return F.when(n > 0, F.floor((s * 2 + n) / (n * 2)) / 10000)
