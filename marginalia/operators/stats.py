"""Counts. Every one is a grouped count with a map-side part, so a hot value costs one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SPLITS
from ..functions.text import clean


def _count():
    return F.count(F.lit(1)).alias("count")


def language_top(df: DataFrame, n: int = 10, col: str = "language") -> DataFrame:
    return df.groupBy(col).agg(_count()).orderBy(F.desc("count"), col).limit(n)


def language_counts(df: DataFrame, col: str = "language") -> DataFrame:
    """Rows per language, largest first. Rows without a language are not counted."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(_count()).orderBy(F.desc("count"), col)


def language_distribution(df: DataFrame, col: str = "language") -> DataFrame:
    """Rows per split and language, by name ignoring case."""
    return df.groupBy("split", col).agg(_count()).orderBy("split", F.lower(col), col)


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(_count())


def corpus_matrix(df: DataFrame, splits: Sequence[str] = SPLITS, totals: bool = False) -> DataFrame:
    """One row per language, one column per split; with ``totals`` a last row with language null for all of them."""
    columns = [F.count_if(F.col("split") == s).alias(s) for s in splits]
    grouped = df.rollup("language") if totals else df.groupBy("language")
    return grouped.agg(*columns)


def language_norm_counts(df: DataFrame, col: str = "language_norm") -> DataFrame:
    """Rows per normalised language; blank ones are left out."""
    return df.where(clean(col) != "").groupBy(col).agg(_count())

