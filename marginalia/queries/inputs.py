"""The given tables in the row shapes of the library (the definitions are in FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import COMMIT_LANGUAGES
from ..operators.bounds import few_values
from ..operators.columns import with_fields
from ..operators.ordering import with_position
from ..operators.sampling import stratified_split
from ..sources.corpora import save_scratch, spread_scan

COMMIT_GROUPS = len(COMMIT_LANGUAGES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``ord, language, code, docstring``; four docstring shapes. A table of few files is spread over the cores."""
    return code_columns(spread_scan(table(spark, sf, "documents"), "doc_id"))


def code_columns(documents: DataFrame) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    shape = F.col("doc_id") % 4
    docstring = (
        F.when(shape == 0, F.concat(first, F.lit("\n\n"), "text"))
        .when(shape == 1, F.concat(first, F.lit("\n:param x: value")))
        .when(shape == 2, first)
        .otherwise(F.concat(F.lit("\n"), "text"))
    )
    return documents.select(
        F.col("doc_id").alias("ord"), F.col("lang").alias("language"), F.col("text").alias("code"), docstring.alias("docstring")
    )


def commit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``ord, language, subject, old_contents, message, new_contents`` from runs of four turns."""
    spoken = table(spark, sf, "conversations").where(F.col("role") != "system")
    placed = with_position(spoken.select("conv_id", "turn", "text"), "turn", ["conv_id"], "p")
    fields = ("subject", "old_contents", "message", "new_contents")
    languages = F.array(*[F.lit(name) for name in sorted(COMMIT_LANGUAGES)])
    language = F.get(languages, (F.col("conv_id") % len(COMMIT_LANGUAGES)).cast("int"))
    return (
        placed.withColumns({"g": F.expr("(p - 1) div 4"), "q": F.expr("(p - 1) % 4")})
        .groupBy("conv_id", "g")
        .agg(*[F.max(F.when(F.col("q") == i, F.col("text"))).alias(f) for i, f in enumerate(fields)])
        .select((F.col("conv_id") * 1_000_000 + F.col("g")).alias("ord"), language.alias("language"), *fields)
    )


def log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``run, idx, step, loss, eval_loss, learning_rate, epoch``: a sparse training log."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        (F.col("user_id") % 4).cast("int").alias("run"),
        F.col("event_id").alias("idx"),
        F.when(~F.coalesce(kind.isin("error", "signup"), F.lit(False)), F.col("event_id").cast("int")).alias("step"),
        F.when(kind == "click", F.col("value")).alias("loss"),
        F.when(kind.isin("view", "error"), F.col("value")).alias("eval_loss"),
        F.when(kind == "purchase", F.col("value") / 1000).alias("learning_rate"),
        F.when(kind.isin("signup", "view"), F.floor(F.col("event_id") / 1000).cast("double")).alias("epoch"),
    )


def language_bound(spark: SparkSession, sf: str) -> int | None:
    """Number of code languages if it is small (checked on the one column), else None."""
    found = few_values(table(spark, sf, "documents"), "lang")
    return None if found is None else len(found)


def code_split(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(code_rows(spark, sf), "language", groups=language_bound(spark, sf))


# Tables that several queries of one application read are written once, like the corpora saved between two steps.
_SAVED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def saved(name: str, spark: SparkSession, sf: str, make: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SAVED:
        df = make()
        _SAVED[key] = save_scratch(df, *partition_by), df.schema
    path, schema = _SAVED[key]
    return spark.read.schema(schema).parquet(path)


def forget_saved() -> None:
    """Let the next query write its inputs anew (so that a benchmark times all of its work)."""
    _SAVED.clear()


def commit_split(spark: SparkSession, sf: str) -> DataFrame:
    """The commit rows are saved first, as a raw corpus would be; the split reads them more than once."""
    raw = saved("commit_rows", spark, sf, lambda: commit_rows(spark, sf))
    return stratified_split(raw, "language", groups=COMMIT_GROUPS)


def saved_code(spark: SparkSession, sf: str) -> DataFrame:
    return saved("code_split", spark, sf, lambda: code_split(spark, sf), "split")


def saved_commits(spark: SparkSession, sf: str) -> DataFrame:
    return saved("commit_split", spark, sf, lambda: commit_split(spark, sf), "split")


def raw_code(df: DataFrame) -> DataFrame:
    """Code rows under the column names of the raw corpus."""
    return df.withColumnsRenamed({"code": "func_code_string", "docstring": "func_documentation_string"})


FIELDS = ("code", "docstring", "old_contents", "new_contents", "subject", "message")


def mixed_rows(code: DataFrame, commits: DataFrame) -> DataFrame:
    """Code rows and commit rows in one table, the fields of the other kind null."""
    keys = [c for c in ("ord", "language", "split") if c in code.columns]
    parts = [
        with_fields(df, FIELDS).select(F.lit(name).alias("source"), *keys, *FIELDS)
        for name, df in (("code", code), ("commit", commits))
    ]
    return parts[0].unionByName(parts[1])
