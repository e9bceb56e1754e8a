"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def python_round(c, digits: int) -> Column:
    """Python's ``round(x, digits)``: half-to-even on the exact binary value.

    Spark's ``round``/``bround`` round the shortest decimal text instead
    (2.675 -> 2.68; Python gives 2.67). ``format_number`` formats through
    Java's DecimalFormat, which rounds the exact binary value with HALF_EVEN.
    """
    x = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.format_number(x, digits), ",", "").cast("double")
