"""Row order without a global sort: positions, running values, hash cuts and first-k per group.

Spark tables have no row order, so order is an explicit unique BIGINT column. Nothing here sorts a whole group in
one task. A group is divided into buckets of neighbouring rows; only the small per-bucket aggregates meet in one
place, and each row then needs its own bucket plus the total of the buckets before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import SEED
from ..session import scratch_folder
from .bounds import SALTS, attach, join_null_safe, spread

BUCKET_BITS = 16
HASH_DIGITS = 3


def shuffle_key(key: str | Column, seed: int = SEED) -> Column:
    """Pseudo-random order key. MD5 gives the same order on every engine and for every partitioning."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


# ---------------------------------------------------------------------------------------------------------
# Totals of everything before a bucket
# ---------------------------------------------------------------------------------------------------------
_COMBINE = {"sum": F.sum, "max": F.max}


def kept(df: DataFrame) -> DataFrame:
    """The table written to the shared scratch folder and read from there, so that it is worked out once."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _before(by: Sequence[str], order: str):
    return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _merge(how: str, a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if how == "sum" else F.greatest(a, b)


def carry_table(
    df: DataFrame, by: Sequence[str], order: str, measures: Mapping[str, tuple[Column, str]]
) -> DataFrame:
    """Per (group, bucket): each measure over all rows of the group in earlier buckets (null if there are none).

    A measure is an expression with ``"sum"`` or ``"max"``. Order values are read as digits of 16 bits: a bucket is what the
    last digit leaves, a block what the last two leave, and so on. On each level a window runs over the places that share
    all higher digits, so no task gets more than 65,536 totals, whatever the size of the group and the spread of its order
    values. The bucket totals are written once.
    """
    by, names = list(by), list(measures)
    totals = (
        df.withColumn("_b1", F.shiftright(F.col(order), BUCKET_BITS))
        .groupBy(*by, "_b1")
        .agg(*[_COMBINE[how](expr).alias(name) for name, (expr, how) in measures.items()])
    )
    level = kept(totals)
    result = None
    for n in (1, 2, 3):
        here, above = f"_b{n}", f"_b{n + 1}"
        level = level.withColumn(above, F.shiftright(here, BUCKET_BITS)) if n < 3 else level
        window = _before([*by, above] if n < 3 else by, here)
        sums = {name: _COMBINE[how](name).over(window) for name, (_, how) in measures.items()}
        before = level.select(*by, here, *([above] if n < 3 else []), *[s.alias(f"_{n}_{name}") for name, s in sums.items()])
        result = before if result is None else join_null_safe(result, before, [*by, here])
        if n < 3:
            level = level.groupBy(*by, above).agg(*[_COMBINE[how](name).alias(name) for name, (_, how) in measures.items()])
    merged = []
    for name in names:
        how = measures[name][1]
        value = F.col(f"_1_{name}")
        for n in (2, 3):
            value = _merge(how, value, F.col(f"_{n}_{name}"))
        merged.append(value.alias(name))
    return result.select(*by, F.col("_b1").alias("_bucket"), *merged)


def with_position(df: DataFrame, order: str, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """1-based position of each row in its group, by a unique BIGINT ``order``.

    The rows move once, to their (group, bucket); the join and the window share that partitioning.
    """
    by = list(by)
    carry = carry_table(df, by, order, {"_offset": (F.lit(1), "sum")})
    in_bucket = W.partitionBy(*by, "_bucket").orderBy(order)
    return (
        join_null_safe(df.withColumn("_bucket", F.shiftright(F.col(order), BUCKET_BITS)), carry, [*by, "_bucket"])
        .withColumn(name, (F.row_number().over(in_bucket) + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_offset")
    )


def with_running_max(
    df: DataFrame, by: Sequence[str], order: str, values: Mapping[str, Column], inclusive: bool = False
) -> DataFrame:
    """Largest value so far in the order of the group, before the row itself unless ``inclusive``."""
    by = list(by)
    carry = carry_table(df, by, order, {f"_carry_{n}": (v, "max") for n, v in values.items()})
    frame = (
        W.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    out = join_null_safe(df.withColumn("_bucket", F.shiftright(F.col(order), BUCKET_BITS)), carry, [*by, "_bucket"])
    for name, value in values.items():
        out = out.withColumn(name, F.greatest(F.max(value).over(frame), F.col(f"_carry_{name}")))
    return out.drop("_bucket", *[f"_carry_{n}" for n in values])


# ---------------------------------------------------------------------------------------------------------
# Rank over the whole table
# ---------------------------------------------------------------------------------------------------------
def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based rank of each row in the order of the whole table (the order must be total).

    The rows are worked out and written once, as ranges are sampled from them before they are dealt. Dealt rows are written
    too, so the ranges stay what they are; each range is ranked by itself and gets the number of rows before it. One row per
    range meets in one place.
    """
    placed = kept(kept(df).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(_before([], "_part")), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_offset")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, rank).drop("_part", "_offset")


# ---------------------------------------------------------------------------------------------------------
# Quantiles
# ---------------------------------------------------------------------------------------------------------
def exact_quantiles(df: DataFrame, values: Mapping[str, Column], by: Sequence[str], permilles: Sequence[int]) -> DataFrame:
    """``by, measure, rows, p<permille / 10>...``: exact discrete quantiles of whole numbers, one row per group and measure.

    The quantile at p permille of n values is the one with rank ceil(n p / 1000), at least 1. Rows are counted per group and
    value with a map-side part; running counts over that histogram (by buckets of 65,536 values) tell which value holds a
    rank. No row is sorted and no group meets in one task. Null values count as rows, not as values; a group without values
    has null quantiles.
    """
    by = list(by)
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), v.cast("bigint").alias("_value")) for name, v in values.items()]))
    keys = [*by, "measure"]
    counted = df.select(*by, listed.alias("_m")).select(*by, "_m.measure", "_m._value").groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    histogram = kept(counted)
    known = F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    totals = histogram.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.sum(known).alias("_all"))
    carry = carry_table(histogram, keys, "_value", {"_offset": (known, "sum")})
    inside = W.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    running = (
        join_null_safe(histogram.withColumn("_bucket", F.shiftright("_value", BUCKET_BITS)), carry, [*keys, "_bucket"])
        .withColumn("_upto", F.sum(known).over(inside) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )
    placed = join_null_safe(running, totals, keys)
    quantiles = []
    for p in permilles:
        rank = F.greatest(F.expr(f"(_all * {int(p)} + 999) div 1000"), F.lit(1))
        here = (F.col("_upto") >= rank) & (F.col("_upto") - known < rank)
        quantiles.append(F.max(F.when(here, F.col("_value"))).alias("p" + f"{p / 10:g}".replace(".", "_")))
    return placed.groupBy(*keys, "rows").agg(*quantiles)


# ---------------------------------------------------------------------------------------------------------
# Hash order
# ---------------------------------------------------------------------------------------------------------
def hash_offsets(df: DataFrame, by: Sequence[str], row_key: str, seed: int, digits: int = HASH_DIGITS) -> DataFrame:
    """Histogram of the hash order: per (group, hash prefix) the row count and the count before it.

    At most 16**digits rows per group reach the window.
    """
    by = list(by)
    counts = (
        df.select(*by, F.left(shuffle_key(row_key, seed), F.lit(digits)).alias("_prefix"))
        .groupBy(*by, "_prefix")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    return counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(_before(by, "_prefix")), F.lit(0)))


def with_shuffle_position(
    df: DataFrame, row_key: str, by: Sequence[str] = (), seed: int = SEED, name: str = "shuffle_pos", digits: int = 4
) -> DataFrame:
    """1-based position of each row in the seeded random order of its group; the rows move once.

    Hash prefixes are uniform, so neither a large group nor the value range of ``row_key`` gives a hot task.
    """
    by = list(by)
    offsets = hash_offsets(df, by, row_key, seed, digits).drop("_rows")
    order = W.partitionBy(*by, "_prefix").orderBy("_key", row_key)
    keyed = df.withColumn("_key", shuffle_key(row_key, seed)).withColumn("_prefix", F.left("_key", F.lit(digits)))
    return (
        join_null_safe(keyed, offsets, [*by, "_prefix"])
        .withColumn(name, (F.row_number().over(order) + F.col("_offset")).cast("bigint"))
        .drop("_key", "_prefix", "_offset")
    )


def hash_cuts(
    df: DataFrame,
    by: Sequence[str],
    row_key: str,
    ranks: Mapping[str, Column],
    seed: int = SEED,
    groups: int | None = None,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Exact order statistics of the hash order, one row per group, without sorting or moving the rows.

    ``ranks`` maps a name to an expression of ``n`` (rows in the group). The result holds, per name, the order key
    of the row with that 1-based rank, as ``struct(_key, row_key)``; null or no row at all if the rank is 0.

    The histogram tells which prefix holds a rank, and only the rows of that prefix (one in 4,096) are ranked.
    """
    by = list(by)
    histogram = hash_offsets(df, by, row_key, seed, digits).withColumn("n", F.sum("_rows").over(W.partitionBy(*by)))
    requests = F.array(*[F.struct(F.lit(k).alias("_cut"), v.cast("bigint").alias("_rank")) for k, v in ranks.items()])
    # One prefix per group and cut matches, so this side has at most groups * len(ranks) rows.
    cut_prefix = (
        histogram.select(*by, "_prefix", "_offset", "_rows", F.explode(requests).alias("_r"))
        .select(*by, "_prefix", "_r._cut", (F.col("_r._rank") - F.col("_offset")).alias("_local"), "_rows")
        .where("_local > 0 AND _local <= _rows")
        .drop("_rows")
    )
    bound = None if groups is None else groups * len(ranks)
    keyed = df.select(*by, F.col(row_key).alias("_id"), shuffle_key(row_key, seed).alias("_key")).withColumn(
        "_prefix", F.left("_key", F.lit(digits))
    )
    near = attach(keyed, cut_prefix, [*by, "_prefix"], "_id", bound)
    ranked = near.withColumn("_rn", F.row_number().over(W.partitionBy(*by, "_cut").orderBy("_key", "_id")))
    found = ranked.where("_rn = _local").select(*by, "_cut", F.struct("_key", "_id").alias("_at"))
    return found.groupBy(*by).agg(
        *[F.first(F.when(F.col("_cut") == k, F.col("_at")), ignorenulls=True).alias(k) for k in ranks]
    )


# ---------------------------------------------------------------------------------------------------------
# First k rows per group
# ---------------------------------------------------------------------------------------------------------
def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, row_key: str) -> DataFrame:
    """The first ``k`` rows of each group.

    Two row limits: per (group, salt), then per group. Up to spark.sql.optimizer.windowGroupLimitThreshold each has a
    map-side part, so a task sends at most ``k`` rows per group; beyond it, a salted task ranks 1/64 of a group. The last
    task gets at most 64 * k rows of a group.
    """
    by = list(by)
    salted = W.partitionBy(*by, "_salt").orderBy(*order)
    final = W.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_salt", spread(row_key, parts=SALTS))
        .withColumn("_rn", F.row_number().over(salted))
        .where(F.col("_rn") <= k)
        .withColumn("_rn", F.row_number().over(final))
        .where(F.col("_rn") <= k)
        .withColumnRenamed("_rn", "rank_in_group")
        .drop("_salt")
    )
