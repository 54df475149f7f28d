"""Chat tables: rendering, checking and comparing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import code_chat, commit_chat, extract_target, has_tag, mixed_chat, prompt_of, rest_of
from ..functions.chat import until_end_tag
from ..functions.profiles import Profile
from ..functions.text import preview_text
from .columns import COMMIT_FIELDS, with_fields
from .filters import gate_or_all

CARRIED = ("ord", "source", "split", "language")


def _text_only(df: DataFrame, text: Column) -> DataFrame:
    """Keys and text; the source columns are dropped, so code text is not carried twice."""
    return df.select(*[c for c in CARRIED if c in df.columns], text.alias("text"))


def render_code(df: DataFrame, profile: Profile | str) -> DataFrame:
    return _text_only(with_fields(df, COMMIT_FIELDS), code_chat(profile))


def render_commit(df: DataFrame, profile: Profile | str) -> DataFrame:
    return _text_only(with_fields(df, (*COMMIT_FIELDS, "docstring")), commit_chat(profile))


def render_mixed(df: DataFrame, profile: Profile | str) -> DataFrame:
    return _text_only(with_fields(df, (*COMMIT_FIELDS, "code", "docstring")), mixed_chat(profile))


def ensure_chat(df: DataFrame, gate: Column, profile: Profile | str, splits: Sequence[str] | None = None) -> DataFrame:
    """Leave the rows of a split that has chat text alone; gate (with fallback) and render those of the others.

    A split has text if any of its rows has one; which those are is one row of aggregates. A table without splits that has
    a text column is left alone as a whole.
    """
    fields = (*COMMIT_FIELDS, "code", "docstring")
    if "text" not in df.columns:
        return render_mixed(gate_or_all(with_fields(df, fields), gate, splits), profile)
    if "split" not in df.columns:
        return df
    name = F.coalesce(F.col("split"), F.lit("\0"))
    done = F.array_contains(df.agg(F.collect_set(F.when(F.col("text").isNotNull(), name)).alias("done")).scalar(), name)
    rest = render_mixed(gate_or_all(with_fields(df.where(~done).drop("text"), fields), gate, splits), profile)
    return _text_only(df.where(done), F.col("text")).unionByName(rest)


def check_chat(df: DataFrame) -> DataFrame:
    """The rows whose text has no assistant tag; none in a sound table."""
    return df.where(~has_tag("text"))


def split_prompt(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt": prompt_of("text"), "rest": rest_of("text")})


def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", extract_target("text"))


def compare_pairs(predictions: DataFrame, chat: DataFrame, key: str = "ord", width: int = 400) -> DataFrame:
    """Prediction beside ground truth, cut for reading, with an exact-match flag on the uncut texts."""
    pairs = predictions.select(key, until_end_tag("prediction").alias("_p")).join(
        chat.select(key, extract_target("text").alias("_t")), key
    )
    return pairs.select(
        key,
        preview_text("_t", width, ellipsis=True).alias("truth"),
        preview_text("_p", width, ellipsis=True).alias("prediction"),
        F.coalesce(F.col("_p") == F.col("_t"), F.lit(False)).alias("exact"),
    )
