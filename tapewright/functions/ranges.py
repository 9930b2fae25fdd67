"""Relations of half-open ranges, over columns of one unit. NULL edges give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(start: Column, end: Column, at: Column) -> Column:
    """Whether an instant is in a range; its end isn't."""
    return (start <= at) & (at < end)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two ranges share more than an edge."""
    return (start < other_end) & (other_start < end)


def intersection(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """What two ranges share, as a struct of start and end; NULL if they share nothing."""
    return F.when(overlaps(start, end, other_start, other_end), F.struct(F.greatest(start, other_start).alias("start"), F.least(end, other_end).alias("end")))
