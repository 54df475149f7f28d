"""Code corpus: raw code rows to a cleaned set and to compact per-language sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import QUOTAS
from ..functions.gates import is_good_summary
from ..functions.text import summary
from ..operators.columns import normalize_code
from ..operators.dedup import compact


def clean_code(raw: DataFrame) -> DataFrame:
    """Normalise, cut the docstring to its summary, and keep the rows with a good one. No shuffle."""
    rows = normalize_code(raw).withColumn("docstring", summary("docstring"))
    return rows.where(is_good_summary(F.col("docstring")))


def compact_code(cleaned: DataFrame, targets: Mapping[str, int] = QUOTAS, languages: int | None = None) -> DataFrame:
    """Length gate, dedup and quota for each language and split, over all of them at once.

    ``cleaned`` is read twice (keys, then the chosen rows): write it first and pass the written table.
    """
    return compact(cleaned, "code", targets, languages)
