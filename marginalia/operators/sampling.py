"""Seeded samples, exact splits, shuffles and mixes. Results depend on the rows and the seed, never on partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import MIX_TOTALS, SEED, TINY_SLICES
from ..functions.text import preview_text
from ..session import group_limit_threshold
from .bounds import attach, keep_keys
from .ordering import first_k, hash_cuts, shuffle_key, with_shuffle_position


def by_cut(order: str, seed: int, cut: str) -> Column:
    """True for the rows up to a cut from ``hash_cuts``."""
    at = F.col(cut)
    key = shuffle_key(order, seed)
    return F.coalesce((key < at["_key"]) | ((key == at["_key"]) & (F.col(order) <= at["_id"])), F.lit(False))


def choose_keys(
    keys: DataFrame, by: Sequence[str], quota: Column, most: int, seed: int, order: str, groups: int | None = None
) -> DataFrame:
    """Order keys of the first ``quota`` rows of each group in hash order; ``most`` is the largest quota.

    Small quotas are row limits. Larger ones are the exact cut of the hash order, which sorts no group.
    """
    by = list(by)
    if most <= group_limit_threshold(keys.sparkSession):
        ranked = first_k(keys.select(*by, order), by, [shuffle_key(order, seed), order], most, order)
        return ranked.where(F.col("rank_in_group") <= quota).select(order)
    return cut_rows(keys.select(*by, order), by, quota, seed, order, groups).select(order)


def cut_rows(df: DataFrame, by: Sequence[str], quota: Column, seed: int, order: str, groups: int | None) -> DataFrame:
    """Rows up to the quota of their group, found by the cut; the rows are not moved if ``groups`` is known."""
    cuts = hash_cuts(df, by, order, {"_cut_sample": F.least(quota.cast("bigint"), F.col("n"))}, seed, groups)
    return attach(df, cuts, by, order, groups).where(by_cut(order, seed, "_cut_sample")).drop("_cut_sample")


def sample_k(
    df: DataFrame,
    k: int,
    seed: int = SEED,
    by: Sequence[str] = (),
    order: str = "ord",
    groups: int | None = None,
) -> DataFrame:
    """min(k, n) rows of each group, without replacement. ``groups`` is a proved bound on their number."""
    by, source = list(by), df
    if not by:
        by, groups, source = ["_all"], 1, df.withColumn("_all", F.lit(0))
    if k > group_limit_threshold(df.sparkSession):
        return cut_rows(source, by, F.lit(k), seed, order, groups).select(*df.columns)
    chosen = choose_keys(source, by, F.lit(k), k, seed, order)
    return keep_keys(df, chosen, order, None if groups is None else k * groups)


def quota_of(quotas: Mapping[str, int]) -> Column:
    pairs = [x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col("split"))


def sample_quota(df: DataFrame, quotas: Mapping[str, int], seed: int = SEED, order: str = "ord") -> DataFrame:
    """Up to ``quotas[split]`` rows of each split; rows of other splits are left out.

    The sum of the quotas bounds the chosen keys, so they are broadcast if that is small.
    """
    df = df.where(F.col("split").isin(list(quotas)))
    most = max(quotas.values())
    if most > group_limit_threshold(df.sparkSession):
        return cut_rows(df, ["split"], quota_of(quotas), seed, order, len(quotas)).select(*df.columns)
    chosen = choose_keys(df, ["split"], quota_of(quotas), most, seed, order)
    return keep_keys(df, chosen, order, sum(quotas.values()))


def stratified_split(
    df: DataFrame,
    by: str = "language",
    weights: Mapping[str, int] | None = None,
    seed: int = SEED,
    order: str = "ord",
    groups: int | None = None,
) -> DataFrame:
    """Exact split of every stratum, as a ``split`` column. Weights are tenths: 7, 1, 2 by default.

    Each stratum of n rows gives the first ``7 * n div 10`` rows of its hash order to the first part, and so on.
    Only the cut points are computed; the rows compare their own key with them and do not move.
    """
    weights = {"train": 7, "validation": 1, "test": 2} if weights is None else dict(weights)
    total = sum(weights.values())
    names, ranks, upto = list(weights), {}, 0
    for name in names[:-1]:
        upto += weights[name]
        ranks[f"_cut_{name}"] = F.expr(f"{upto} * n div {total}")
    cuts = hash_cuts(df, [by], order, ranks, seed, groups)
    label = F.lit(names[-1])
    for name in reversed(names[:-1]):
        label = F.when(by_cut(order, seed, f"_cut_{name}"), F.lit(name)).otherwise(label)
    return attach(df, cuts, [by], order, groups, "left").withColumn("split", label).drop(*ranks)


def shuffle_rows(df: DataFrame, seed: int = SEED, order: str = "ord") -> DataFrame:
    """Rows in seeded random order (a range-partitioned sort)."""
    return df.orderBy(shuffle_key(order, seed), order)


def shuffle_positions(df: DataFrame, seed: int = SEED, order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """The same order as an explicit ``shuffle_pos`` column, which outlives a write."""
    return with_shuffle_position(df, order, by, seed)


def sample_preview(df: DataFrame, n: int = 3, seed: int = SEED, width: int = 800, order: str = "ord", cols: Sequence[str] = ()) -> DataFrame:
    """n random rows for inspection, with long text columns cut to ``width``."""
    return sample_k(df, n, seed, order=order).withColumns({c: preview_text(F.coalesce(F.col(c), F.lit("")), width) for c in cols})


def head_rows(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return df.orderBy(order).limit(n)


def tiny_slice(df: DataFrame, gate: Column, sizes: Mapping[str, int] = TINY_SLICES, seed: int = SEED, order: str = "ord") -> DataFrame:
    """A few gated rows of each split."""
    return sample_quota(df.where(gate), sizes, seed, order)


def parts_of(total: int, names: Sequence[str], shares: Mapping[str, int] | None = None) -> dict[str, int]:
    """How many of ``total`` rows each source gives: by percent, or evenly.

    What rounding down leaves goes to the largest remainders (ties: in order), so the parts give the whole total. An even
    mix of two is the exception of the mix recipe: half each, rounded down.
    """
    if shares is None and len(names) == 2:
        return {name: total // 2 for name in names}
    weights = {name: 1 for name in names} if shares is None else {name: shares[name] for name in names}
    whole = len(names) if shares is None else 100
    parts = {name: total * w // whole for name, w in weights.items()}
    left = total * sum(weights.values()) // whole - sum(parts.values())
    for name in sorted(names, key=lambda x: -(total * weights[x] % whole))[:left]:
        parts[name] += 1
    return parts


def mix(
    sources: Mapping[str, DataFrame],
    totals: Mapping[str, int] = MIX_TOTALS,
    shares: Mapping[str, int] | None = None,
    seed: int = SEED,
    order: str = "ord",
) -> DataFrame:
    """Mix of several sources by share (in percent), with a ``source`` column; an even mix by default.

    Each source gives its part of a split's total (see ``parts_of``), or all it has: a short source makes the mix smaller.
    ``shuffle_pos`` is the seeded random order of each split over all sources.
    """
    quotas = {split: parts_of(total, list(sources), shares) for split, total in totals.items()}
    parts = [
        sample_quota(df, {s: q[name] for s, q in quotas.items()}, seed, order).withColumn("source", F.lit(name))
        for name, df in sources.items()
    ]
    mixed = reduce(lambda a, b: a.unionByName(b), parts)
    row = F.concat_ws(":", "source", F.col(order).cast("string"))
    if max(totals.values()) <= group_limit_threshold(mixed.sparkSession):
        # The totals bound a split, so a plain window will do.
        in_split = W.partitionBy("split").orderBy(shuffle_key(row, seed), row)
        return mixed.withColumn("shuffle_pos", F.row_number().over(in_split).cast("bigint"))
    return with_shuffle_position(mixed.withColumn("_row", row), "_row", ["split"], seed).drop("_row")
