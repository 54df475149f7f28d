"""Set operations: concatenation and distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.text import clean


def concat(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables, duplicates kept; columns are matched by name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def distinct_values(dfs: Sequence[DataFrame], col: str) -> DataFrame:
    """Distinct union of one column over several tables. Only that column is read."""
    return concat(*[df.select(col) for df in dfs]).distinct()


def sorted_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values that are not blank, sorted."""
    return df.select(col).where(clean(col) != "").distinct().orderBy(col)
