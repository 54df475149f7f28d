"""Projections: raw rows to the fixed row shapes, tags, labels, rendered text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CODE_INSTRUCTION, COMMIT_INSTRUCTION, DEFAULT_LANGUAGE
from ..functions.chat import code_chat
from ..functions.profiles import Profile
from ..functions.text import blank_if_null, clean, language_norm
from .bounds import attach
from .ordering import with_rank

KEYS = ("ord", "split")
COMMIT_FIELDS = ("old_code", "old_contents", "new_code", "new_contents", "target", "subject", "message")


def with_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the optional fields that are absent, as typed nulls."""
    missing = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def _carried(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def normalize_code(df: DataFrame) -> DataFrame:
    """Raw code rows to ``instruction, code, docstring, language`` (row order and split are carried along).

    Language falls back to ``"code"`` when the column is absent; a null language stays null.
    """
    language = F.col("language") if "language" in df.columns else F.lit(DEFAULT_LANGUAGE)
    return df.select(
        *_carried(df),
        F.lit(CODE_INSTRUCTION).alias("instruction"),
        F.col("func_code_string").alias("code"),
        blank_if_null("func_documentation_string").alias("docstring"),
        language.alias("language"),
    )


def normalize_commit(df: DataFrame) -> DataFrame:
    """Raw commit rows to ``instruction, old_code, new_code, language, message, subject``; text is stripped."""
    df = with_fields(df, ("old_contents", "new_contents", "message", "subject"))
    named = next((F.col(n) for n in ("language", "lang") if n in df.columns), F.lit(DEFAULT_LANGUAGE))
    return df.select(
        *_carried(df),
        F.lit(COMMIT_INSTRUCTION).alias("instruction"),
        clean("old_contents").alias("old_code"),
        clean("new_contents").alias("new_code"),
        named.alias("language"),
        clean("message").alias("message"),
        clean("subject").alias("subject"),
    )


def tag(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep these columns only. The scan reads no others."""
    return df.select(*cols)


def label_table(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """``col, out``: every distinct label and its 0-based rank, by a distributed rank of any number of labels."""
    labels = df.select(col).where(F.col(col).isNotNull()).distinct()
    return with_rank(labels, [F.asc(col)], "_rank").select(col, (F.col("_rank") - 1).cast("int").alias(out))


def encode_label(df: DataFrame, col: str, names: Sequence[str] | None = None, out: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Replace a label by its 0-based rank among the sorted distinct labels, or by its place in ``names``.

    Without ``names`` the rows meet the table of labels (``labels``, if there is one already) in a join; null labels stay null.
    """
    if names is not None:
        return df.withColumn(out or col, label_code(F.col(col), list(names)))
    label, code = (labels if labels is not None else (labels := label_table(df, col))).columns
    return _looked_up(df, col, labels.select(F.col(label).alias(col), F.col(code).alias("_found")), out)


def _looked_up(df: DataFrame, col: str, table: DataFrame, out: str | None) -> DataFrame:
    """The column's value replaced by ``_found`` of the table. It is broadcast if it is small (it is counted); beyond that the
    rows are spread over salts by all of their columns, so a value that a third of them has is many tasks' work."""
    met = attach(df, table, [col], F.xxhash64(*df.columns), table.count(), "left")
    return met.withColumn(out or col, F.col("_found")).drop("_found").select(*dict.fromkeys([*df.columns, out or col]))


def label_code(value: Column, names: Sequence[str]) -> Column:
    position = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(position > 0, (position - 1).cast("int"))


def decode_label(
    df: DataFrame, col: str, names: Sequence[str] | None = None, out: str | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Replace a code by its label: by its place in ``names``, or without them by a join with ``labels`` (label, code)."""
    if names is None:
        if labels is None:
            raise ValueError("decode_label takes names or a label table")
        label, code = labels.columns
        return _looked_up(df, col, labels.select(F.col(code).alias(col), F.col(label).alias("_found")), out)
    decoded = F.try_element_at(F.array(*[F.lit(n) for n in names]), F.col(col).cast("int") + 1)
    return df.withColumn(out or col, decoded)


def with_text(df: DataFrame, profile: Profile | str = "code_by_language") -> DataFrame:
    """Every source column, the rendered text and the normalised language."""
    return df.withColumns({"text": code_chat(profile), "language_norm": language_norm("language")})
