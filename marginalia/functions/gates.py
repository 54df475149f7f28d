"""Quality gates: boolean columns that are never null.

They can be used in ``filter``, counted in a report, or applied to a stream. A gate refers to its text once, since a
filter computes an expression as often as it occurs: tests on one text are one pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MAX_LINES, MIN_LINES, SENTENCE_ENDS, WEAK_COMMIT_STARTS, WEAK_SUMMARY_STARTS
from .text import (
    Name,
    blank_if_null,
    clean,
    col,
    first_nonempty,
    line_count,
    target_or_fallback,
)
from .unicode import letter_char, upper_char


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _sentence(c: Name, min_len: int, weak_starts: tuple[str, ...]) -> Column:
    """At least ``min_len`` characters, upper-case start, sentence end, none of the weak starts."""
    weak, ends = "|".join(weak_starts), "".join(SENTENCE_ENDS)
    return _flag(F.rlike(col(c), F.lit(rf"(?s)\A(?!{weak}){upper_char()}.{{{min_len - 2},}}[{ends}]\z")))


def _wordy(text: Column, min_len: int = 10) -> Column:
    """At least ``min_len`` characters, of which the first is a letter."""
    return _flag(F.rlike(text, F.lit(rf"(?s)\A{letter_char()}.{{{min_len - 1},}}")))


def _within(count: Column, lo: int, hi: int) -> Column:
    """``lo <= count <= hi`` with one reference to the count."""
    return F.abs(count * 2 - F.lit(lo + hi)) <= hi - lo


def before_text() -> Column:
    """Old side of a change, from whichever of its two fields has content."""
    return clean(first_nonempty("old_code", "old_contents"))


def after_text() -> Column:
    return clean(first_nonempty("new_code", "new_contents"))


def is_good_summary(c: Name) -> Column:
    return _sentence(c, 30, WEAK_SUMMARY_STARTS)


def is_good_commit(c: Name) -> Column:
    return _sentence(c, 20, WEAK_COMMIT_STARTS)


def good_code_length(code: Name, lo: int = MIN_LINES, hi: int = MAX_LINES) -> Column:
    return _flag((col(code) != "") & _within(line_count(code), lo, hi))


def good_change_length(before: Name, after: Name, lo: int = MIN_LINES, hi: int = MAX_LINES) -> Column:
    lines = line_count(blank_if_null(before)) + line_count(blank_if_null(after))
    return _flag(_within(lines, lo, hi))


def good_code_row(code: Name = "code", docstring: Name = "docstring", min_len: int = 10) -> Column:
    return (F.length(clean(code)) >= min_len) & (F.length(clean(docstring)) >= min_len)


def good_commit_row(min_len: int = 10) -> Column:
    """Both sides of the change and the target have at least ``min_len`` characters."""
    target = target_or_fallback(None, "target", "subject", "message", collapse=True)
    return (
        (F.length(before_text()) >= min_len) & (F.length(after_text()) >= min_len) & (F.length(target) >= min_len)
    )


def good_doc(docstring: Name = "docstring") -> Column:
    return _wordy(clean(docstring))


def good_commit(target: Name = "target") -> Column:
    return _wordy(clean(target))


def has_min_fields(min_len: int = 10) -> Column:
    """Both sides of the change are there, and the target is long enough."""
    target = target_or_fallback(None, "target", "subject", "message")
    return (before_text() != "") & (after_text() != "") & (F.length(target) >= min_len)


def good_example_raw(min_len: int = 10) -> Column:
    """Rule for a table that mixes code rows (``code`` is not null) and commit rows."""
    target = target_or_fallback(None, "target", "subject", "message")
    commit = (before_text() != "") & (after_text() != "") & _wordy(target, min_len)
    return F.when(F.col("code").isNotNull(), _wordy(clean("docstring"), min_len)).otherwise(commit)


def good_example_relaxed(min_len: int = 8) -> Column:
    return F.length(target_or_fallback("docstring", "target", "subject", "message", strip_first=True)) >= min_len
