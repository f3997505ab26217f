"""Evaluate expensive expressions exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body`` (a one-argument function)."""
    return F.transform(F.array(value), body)[0]


def compute_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections refer to without repeating their computation.

    The optimizer moves filters below projections by copying the expressions they use, and merges projections. For a
    parse or a fold over a whole file that would mean doing the work again at every filter. A generator over a
    one-element array is a row-local boundary neither of them crosses.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
