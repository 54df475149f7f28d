"""Exact duplicates and compact sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import QUOTAS, SEED
from ..functions.gates import good_change_length, good_code_length
from ..functions.text import change_hash, content_hash
from .bounds import keep_keys
from .sampling import choose_keys, quota_of


def dedup_first(df: DataFrame, hash_col: str | Column, order: str = "ord", by: Sequence[str] = ("language", "split")) -> DataFrame:
    """Keep the first row, by ``order``, of each hash in each group.

    The limit of one row per key has a map-side part, so a hash that a third of all rows share sends one row per
    task. The rows move once.
    """
    key = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    window = W.partitionBy(*by, "_hash").orderBy(order)
    return (
        df.withColumn("_hash", key)
        .withColumn("_rn", F.row_number().over(window))
        .where("_rn = 1")
        .drop("_rn", "_hash")
    )


def first_keys(df: DataFrame, hash_col: Column, order: str = "ord", by: Sequence[str] = ("language", "split")) -> DataFrame:
    """The keys (``by`` and ``order``) of the rows ``dedup_first`` keeps, without moving any text."""
    return (
        df.select(*by, order, hash_col.alias("_hash"))
        .groupBy(*by, "_hash")
        .agg(F.min(order).alias(order))
        .select(*by, order)
    )


RULES = {
    "code": (lambda: good_code_length("code"), lambda: content_hash("code")),
    "commit": (
        lambda: good_change_length("old_code", "new_code"),
        lambda: change_hash("old_code", "new_code"),
    ),
}


def compact(
    df: DataFrame,
    kind: str,
    targets: Mapping[str, int] = QUOTAS,
    languages: int | None = None,
    seed: int = SEED,
    order: str = "ord",
) -> DataFrame:
    """Compact set: length gate, dedup, then a seeded sample up to the quota of each (language, split).

    All of it is decided on narrow rows (keys and hashes). The chosen keys, at most ``languages`` times the sum of
    the quotas, then pick the full rows, so no code text is ever shuffled when ``languages`` is given.
    """
    gate, hashed = (make() for make in RULES[kind])
    df = df.where(F.col("split").isin(list(targets)))
    keys = first_keys(df.where(gate), hashed, order)
    groups = None if languages is None else languages * len(targets)
    chosen = choose_keys(keys, ("language", "split"), quota_of(targets), max(targets.values()), seed, order, groups)
    bound = None if languages is None else languages * sum(targets.values())
    return keep_keys(df, chosen, order, bound)
