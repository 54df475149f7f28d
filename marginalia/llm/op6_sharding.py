"""Sharding by jump consistent hashing, as native expressions.

A key's jumps are a pseudo-random walk over growing shard numbers: from shard ``b`` the walk goes on to
``floor((b + 1) / u)`` with the next uniform ``u`` of the key, until it would pass the last shard. No table of shards is
kept, and a larger number of shards only lets some walks take one jump more, so rows move into new shards alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import named, written

ROW_BYTES = 16
SUBS = 4096
FEW_JUMPS = 16


def jump_shard(key: Column, shards: int) -> Column:
    """The shard in ``0..shards-1`` of a key; a null key is a key like any other.

    A walk takes about ln(shards) jumps; the few that are not done after ``FEW_JUMPS`` go on, one step for each shard that is
    left at most, as every jump goes up. The i-th uniform is a hash of (key, i) in (0, 1].
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(walk: Column, i: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1) / F.lit(float(1 << 31))
        onwards = F.floor((walk["next"] + 1) / uniform)
        return F.when(walk["next"] < shards, F.struct(walk["next"].alias("at"), onwards.alias("next"))).otherwise(walk)

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"))
    few = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FEW_JUMPS))), begin, step)
    if shards <= FEW_JUMPS:
        return few["at"].cast("int")

    def go_on(walk: Column) -> Column:
        rest = F.aggregate(F.sequence(F.lit(FEW_JUMPS + 1), F.lit(shards)), walk, step)
        return F.when(walk["next"] < shards, rest["at"]).otherwise(walk["at"])

    return F.get(F.transform(F.array(few), go_on), F.lit(0)).cast("int")


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row per document.

    ``size`` is the UTF-8 length of the text plus 16 bytes; a null text counts as empty. Rows with one doc_id (null is an
    id too) share a shard, each with a slot of its own. Slots number the rows of a shard from 0 without gaps. The rows
    are numbered where they are and written, so the numbers stay; they are ranked within (shard, hash of the number), and the
    running totals of at most 4,096 such parts per shard are added. So a shard is never in one task, not even one of equal rows.
    """
    rows = named(docs, doc_id=doc_id, text=text).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = written(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        "number",
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        F.pmod(F.xxhash64("number"), F.lit(SUBS)).cast("int").alias("sub"),
    )
    totals = rows.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", "sub", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("number")) - 1
    return (
        rows.withColumn("rank", rank)
        .join(bases, ["shard", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("base") + F.col("rank")).cast("bigint").alias("slot"),
            jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, shards: int, path: str, doc_id: str = "doc_id") -> None:
    """The documents in one folder per shard (``shard=0`` ...), several files each if a shard is large.

    The number of a document's file comes from the hash of its id, so a shard is spread over tasks.
    """
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    placed = docs.withColumn(name, jump_shard(F.col(doc_id), shards))
    placed.repartition(F.col(name), F.pmod(F.xxhash64(F.lit("file"), F.col(doc_id)), F.lit(16))).write.partitionBy(name).parquet(path)
