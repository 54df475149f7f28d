"""Side tables: broadcast behind a proved bound, spread over salts beyond it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BROADCAST_ROW_BOUND

SALTS = 64


def few_values(df: DataFrame, *cols: str, at_most: int = 1000) -> list[tuple] | None:
    """The sorted distinct values of ``cols``, or None if there are more than ``at_most``.

    This is the one place where the library looks at data while a plan is being built. The job reads these columns
    only, combines before the shuffle, and returns at most ``at_most + 1`` rows.
    """
    rows = df.select(*cols).distinct().limit(at_most + 1).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is not None, v) for v in r]) if len(rows) <= at_most else None


def spread(*keys: str | Column, parts: int = SALTS) -> Column:
    """A salt in ``0..parts-1`` that depends on the row keys only, so a recomputed task gives the same salt."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def join_null_safe(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi-join in which null keys are equal to each other; the key columns of ``df`` stay. ``small``: broadcast ``side``."""
    rest = [c for c in side.columns if c not in on]
    side = side.select(*[F.col(c).alias(f"_on_{c}") for c in on], *rest)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return df.join(F.broadcast(side) if small else side, same, how).drop(*[f"_on_{c}" for c in on])


def attach(
    df: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    row_key: str | Column,
    bound: int | None,
    how: str = "inner",
) -> DataFrame:
    """Join a per-group side table (at most one row per ``on``) to the rows of ``df``.

    ``bound`` is the proved number of rows in ``side``. Up to the broadcast bound the side is broadcast and ``df``
    is not shuffled. Without a bound, the side is copied to every salt and the join runs on (group, salt), so that
    a group with a third of all rows is still spread over many tasks. Null is a group like any other.
    """
    on = list(on)
    if bound is not None and bound <= BROADCAST_ROW_BOUND:
        return join_null_safe(df, side, on, how, small=True)
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_null_safe(df.withColumn("_salt", spread(row_key)), copies, [*on, "_salt"], how).drop("_salt")


def keep_keys(df: DataFrame, keys: DataFrame, key: str, bound: int | None) -> DataFrame:
    """Rows of ``df`` whose unique ``key`` is in ``keys``; broadcast only under a proved bound.

    Beyond the bound it is a shuffle join on a unique key, which cannot be skewed.
    """
    side = F.broadcast(keys) if bound is not None and bound <= BROADCAST_ROW_BOUND else keys
    return df.join(side, [key], "left_semi")
