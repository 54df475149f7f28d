"""Gates applied to tables: fallback, language choice, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate_or_all(df: DataFrame, gate: Column, splits: Sequence[str] | None = None) -> DataFrame:
    """Filter each split by ``gate``; a split of which nothing would be left is kept whole.

    This holds for every split name (null too), or for those in ``splits`` alone. Which splits pass at all is one row of
    aggregates, read as a scalar subquery. The rows are not shuffled.
    """
    name = F.coalesce(F.col("split"), F.lit("\0"))
    passing = df.agg(F.collect_set(F.when(gate, name)).alias("passing")).scalar()
    fallback = ~F.array_contains(passing, name)
    if splits is not None:
        fallback = fallback & F.coalesce(F.col("split").isin(list(splits)), F.lit(False))
    return df.where(F.coalesce(gate, F.lit(False)) | fallback)


def for_language(df: DataFrame, language: str, col: str = "language") -> DataFrame:
    """One language. On a saved corpus this prunes the folders of the others."""
    return df.where(F.col(col) == language)


def gate_report(df: DataFrame, gates: Mapping[str, Column], by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows in all and rows kept by each gate, in one pass over the data."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(g).alias(name) for name, g in gates.items()]
    )
