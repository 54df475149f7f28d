"""Commit corpus: raw commit rows to a split, cleaned set and to compact per-language sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMMIT_LANGUAGES, QUOTAS
from ..functions.gates import is_good_commit
from ..functions.text import commit_target
from ..operators.columns import normalize_commit
from ..operators.dedup import compact
from ..operators.sampling import stratified_split


def split_commits(raw: DataFrame, languages: int | None = len(COMMIT_LANGUAGES)) -> DataFrame:
    """70/10/20 by language. The split comes before the gate, so the shares hold for ungated rows."""
    return stratified_split(raw, "language", groups=languages)


def clean_commits(split: DataFrame) -> DataFrame:
    """Normalise, make the target from subject and message, and keep the rows with a good one. No shuffle."""
    rows = normalize_commit(split).withColumn("target", commit_target("subject", "message"))
    return rows.where(is_good_commit(F.col("target")))


def compact_commits(
    cleaned: DataFrame, targets: Mapping[str, int] = QUOTAS, languages: int | None = len(COMMIT_LANGUAGES)
) -> DataFrame:
    return compact(cleaned, "commit", targets, languages)
