"""Turning what callers pass into Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_col(x) -> Column:
    """A Column as it is, a string as a column's name, a list as an array literal, anything else as a literal."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    if isinstance(x, list | tuple):
        return F.array(*(F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v) for v in x))
    return F.lit(x)
