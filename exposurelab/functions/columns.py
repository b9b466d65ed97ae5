"""Small helpers for building column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    Without this a value that is used many times over, or inside a lambda, would
    be written out and computed again at every use.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
