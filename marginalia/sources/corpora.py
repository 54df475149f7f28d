"""Reading and writing corpora.

A corpus is one table with ``split`` (and often ``language``) key columns, never a collection of tables. On disk the
keys are folders, so choosing a split or a language prunes the scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import SPLITS, UNSAFE_NAME
from ..functions.text import lower, preview_text, safe_name
from ..operators.bounds import attach
from ..operators.ordering import with_rank
from ..session import scratch_folder

FILE_BITS = 40


def _read(spark: SparkSession, path: str | Sequence[str], fmt: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path if isinstance(path, str) else list(path))


def read_splits(
    spark: SparkSession,
    paths: Mapping[str, str],
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    order: str | None = None,
) -> DataFrame:
    """A corpus that arrives as named splits. The constant ``split`` removes whole inputs when it is filtered.

    ``order`` names a row number to add, unique over all inputs (see ``with_order``).
    """
    return _tagged(spark, paths, "split", fmt, schema, order)


def read_tagged(
    spark: SparkSession,
    paths: Mapping[str, str],
    tag_col: str = "language",
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    order: str | None = None,
) -> DataFrame:
    """One table per tag (such as a language), combined; the tag replaces a column of that name.

    ``order`` names a row number to add, unique over all inputs (see ``with_order``).
    """
    return _tagged(spark, paths, tag_col, fmt, schema, order)


def _tagged(spark, paths, tag_col, fmt, schema, order) -> DataFrame:
    if not paths:
        raise ValueError("no inputs")
    parts = [_read(spark, path, fmt, schema) for path in paths.values()]
    if order:  # numbered before the union: the scan knows its files and row numbers
        parts = _ordered(parts, order)
    tagged = [part.withColumn(tag_col, F.lit(name)) for name, part in zip(paths, parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def with_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Add a stable row number to a table read from Parquet: the number of its file, then the row in the file.

    For tables without a natural key. Call it on the scan itself. More than 2^23 files are an error.
    """
    return _ordered([df], name)[0]


def _ordered(parts: Sequence[DataFrame], name: str) -> list[DataFrame]:
    """Row numbers for several scans. Files with rows are ranked in Spark, by their scan, then by path; only their number is known here."""
    paths = [p.select(F.lit(i).alias("_scan"), _plain_path("_metadata.file_path").alias("_file")).distinct() for i, p in enumerate(parts)]
    ranked = materialize(with_rank(reduce(DataFrame.union, paths), [F.col("_scan"), F.col("_file")], "_file_no"))
    files = ranked.count()
    if files > 1 << (63 - FILE_BITS):
        raise ValueError(f"row numbers have room for {1 << (63 - FILE_BITS)} files")
    out = []
    for i, part in enumerate(parts):
        located = part.withColumns({"_file": _plain_path("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
        own = ranked.where(F.col("_scan") == i).select("_file", "_file_no")
        joined = attach(located, own, ["_file"], "_row", files, "left")
        number = F.coalesce(F.col("_file_no") - 1, F.raise_error(F.lit("the files changed while they were numbered")).cast("bigint"))
        out.append(joined.withColumn(name, F.shiftleft(number, FILE_BITS) + F.col("_row")).drop("_file", "_file_no", "_row"))
    return out


def _plain_path(col: str):
    """File systems differ in the slashes after the scheme."""
    return F.regexp_replace(F.col(col), "^([A-Za-z0-9+.-]+):/+", "$1:/")


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists", rebalance: bool = False) -> None:
    """Write all splits. Each task writes at most one file per split, so the rows are not shuffled for it.

    ``rebalance`` shuffles them for files of even size, which pays after a filter that leaves little of each task.
    """
    df = df.hint("rebalance", "split") if rebalance else df
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_by_language(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one folder per language (safe name) and split.

    There are many folders, so the rows are rebalanced first: large folders are cut into files of even size, and small
    ones are not scattered over one file per task.
    """
    named = df.withColumn("lang_dir", safe_name("language"))
    named.hint("rebalance", "lang_dir", "split").write.mode(mode).partitionBy("lang_dir", "split").parquet(path)


def read_corpus(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """A saved corpus, or one language of it; with language folders only that folder is read."""
    df = spark.read.parquet(path)
    if language is None:
        return df
    if "lang_dir" in df.columns:
        # two languages can share a folder (F# and F*), so the kept name decides
        found = df.where(F.col("lang_dir") == re.sub(UNSAFE_NAME, "_", language.lower()))
        return found.where(lower("language") == language.lower()) if "language" in df.columns else found
    return df.where(F.col("language") == language)


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Give a table of few files one partition per core. A scan that has enough partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def save_scratch(df: DataFrame, *partition_by: str) -> str:
    """Write a table to a new folder of the shared scratch folder; the path."""
    path = scratch_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table that several steps read to the shared scratch folder, and read it from there.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = save_scratch(df, *partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_partitions(spark: SparkSession, path: str, cols: Sequence[str] = ("lang_dir", "split")) -> DataFrame:
    """The key combinations that a saved corpus has, as strings. They are folder names: files are listed, none is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(*[F.col(c).cast("string").alias(c) for c in cols]).distinct()


def missing_partitions(spark: SparkSession, path: str, required: Sequence[Sequence[str]], cols: Sequence[str] = ("lang_dir", "split")) -> DataFrame:
    """The required key combinations that a saved corpus does not have."""
    schema = ", ".join(f"`{c}` string" for c in cols)
    wanted = spark.createDataFrame([tuple(r) for r in required], schema)
    return wanted.join(list_partitions(spark, path, cols), list(cols), "left_anti")


def assert_partitions(spark: SparkSession, path: str, required: Sequence[Sequence[str]], cols: Sequence[str] = ("lang_dir", "split")) -> None:
    """Raise if a saved corpus does not have a required key combination."""
    missing = [tuple(r) for r in missing_partitions(spark, path, required, cols).collect()]
    if missing:
        raise FileNotFoundError(f"missing partitions {cols}: {missing}")


OTHER_SPLITS = "(other)"


def write_counted(df: DataFrame, path: str, splits: Sequence[str] = SPLITS, mode: str = "errorifexists") -> dict[str, int]:
    """``write_corpus``, with the rows of each split counted by the write itself; the input is evaluated once.

    Rows of splits that are not in ``splits`` (null too) are counted together, as ``(other)``.
    """
    seen = Observation()
    known = F.coalesce(F.col("split").isin(list(splits)), F.lit(False))
    counts = [F.count_if(F.col("split") == s).alias(f"n{i}") for i, s in enumerate(splits)]
    write_corpus(df.observe(seen, *counts, F.count_if(~known).alias("other")), path, mode)
    found = seen.get
    return {**{s: found[f"n{i}"] for i, s in enumerate(splits)}, OTHER_SPLITS: found["other"]}


def verify_counts(spark: SparkSession, path: str, written: Mapping[str, int]) -> DataFrame:
    """Rows per split as counted in the write and as the files have them (by their footers), and whether they agree."""
    splits = [s for s in written if s != OTHER_SPLITS]
    expected = spark.createDataFrame([(s, n) for s, n in written.items() if n], "split string, expected bigint")
    name = F.when(F.col("split").isin(splits), F.col("split")).otherwise(F.lit(OTHER_SPLITS))
    found = spark.read.parquet(path).groupBy(name.alias("split")).agg(F.count(F.lit(1)).alias("found"))
    return expected.join(found, "split", "full_outer").withColumn("same", F.col("expected").eqNullSafe(F.col("found")))


def verify_written(df: DataFrame, path: str) -> DataFrame:
    """Rows per split before writing and after reading back, and whether they agree."""
    read_back = df.sparkSession.read.parquet(path)
    before = df.groupBy("split").agg(F.count(F.lit(1)).alias("expected"))
    after = read_back.groupBy("split").agg(F.count(F.lit(1)).alias("found"))
    return before.join(after, "split", "full_outer").withColumn("same", F.col("expected").eqNullSafe(F.col("found")))


def inline_table(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def split_or_empty(df: DataFrame, name: str) -> DataFrame:
    """One split; a missing one is an empty table with the same columns."""
    return df.where(F.col("split") == name)


def split_or_nth(df: DataFrame, name: str, n: int, order: Sequence[str] = SPLITS) -> DataFrame:
    """One split, or the n-th (from 0) of those that are there if it is missing.

    The names that are there come in ``order``, unknown ones last by name. They are one row of aggregates, read as a
    scalar subquery.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("split"))
    ranked = F.struct(F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).alias("place"), F.col("split").alias("name"))
    names = F.transform(F.sort_array(F.collect_set(ranked)), lambda s: s["name"])
    chosen = df.agg(F.when(F.array_contains(names, name), F.lit(name)).otherwise(F.get(names, F.lit(n))).alias("s")).scalar()
    return df.where(F.col("split") == chosen)


def profile(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def preview(df: DataFrame, n: int = 5, width: int = 1000, order: str = "ord") -> DataFrame:
    """First n rows in order, with string columns cut for reading."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.orderBy(order).limit(n).withColumns({c: preview_text(c, width) for c in texts})
