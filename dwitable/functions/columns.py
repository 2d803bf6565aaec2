"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def before(c: ColumnLike, delim: str) -> Column:
    """The part of a string before the first occurrence of ``delim``."""
    return F.substring_index(col(c), delim, 1)


def last_segment(c: ColumnLike) -> Column:
    """The last path segment."""
    return F.substring_index(col(c), "/", -1)
