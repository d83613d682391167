"""Orderings of scores that agree with the priority queues of graph search, and small label functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lowest_first(score: Column) -> Column:
    """Ascending, NaN last."""
    return score.asc_nulls_last()


def highest_first(score: Column) -> Column:
    """Descending, NaN last (Spark alone would put it first)."""
    return F.when(F.isnan(score), F.lit(None)).otherwise(score).desc_nulls_last()


def safe_add(a: Column, b: Column) -> Column:
    """Sum, or null where it overflows."""
    return F.try_add(a, b)


def opposite_end(node: Column) -> Column:
    """The other end of the edge at ``node``."""
    return F.when(F.col("src") == node, F.col("dst")).when(F.col("dst") == node, F.col("src"))


def escape_label(text: Column) -> Column:
    """A label for a quoted DOT string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\l"))
