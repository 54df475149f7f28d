"""Even (or weighted) mix of a code corpus and a commit corpus as chat text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..constants import MIX_TOTALS, SEED
from ..functions.gates import good_code_row, good_commit_row
from ..operators.chat import render_code, render_commit
from ..operators.columns import COMMIT_FIELDS, with_fields
from ..operators.sampling import mix


def code_chats(code: DataFrame) -> DataFrame:
    return render_code(code.where(good_code_row()), "mix_code")


def commit_chats(commits: DataFrame) -> DataFrame:
    commits = with_fields(commits, COMMIT_FIELDS)
    return render_commit(commits.where(good_commit_row()), "mix_commit")


def blend(
    code: DataFrame,
    commits: DataFrame,
    totals: Mapping[str, int] = MIX_TOTALS,
    shares: Mapping[str, int] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``source, ord, split, text, shuffle_pos``. Both inputs are one language's rows with a ``split`` column."""
    keep = ["ord", "split", "text"]
    sources = {"code": code_chats(code).select(*keep), "commit": commit_chats(commits).select(*keep)}
    return mix(sources, totals, shares, seed)
