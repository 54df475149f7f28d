"""Text functions on columns. All of them are built-in expressions; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    CHANGE_SEPARATOR,
    LINE_BREAK,
    SENTENCE_ENDS,
    SPACE_CLASS,
    UNICODE_SPACES,
    UNSAFE_NAME,
)
from . import unicode

Name = Column | str


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_if_null(c: Name) -> Column:
    return F.coalesce(col(c), F.lit(""))


def first_nonempty(*cols: Name) -> Column:
    """The first column that is neither null nor empty; null if there is none. White space counts as content."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def ustrip(c: Name) -> Column:
    """Strip Unicode white space at both ends (``trim`` removes the plain space only)."""
    return F.btrim(col(c), F.lit(UNICODE_SPACES))


def clean(c: Name) -> Column:
    """Null becomes the empty string, the rest is stripped."""
    return ustrip(blank_if_null(c))


def collapse_ws(c: Name) -> Column:
    """Every run of Unicode white space becomes one space, and the ends are stripped."""
    return F.btrim(F.regexp_replace(col(c), SPACE_CLASS + "+", " "))


def summary(c: Name, skip_leading_blank: bool = False) -> Column:
    """Leading block of a docstring, joined to one line.

    Lines are stripped and taken up to the first one that is blank or starts with ``:``. The result is null if no
    line is taken, so a docstring that opens with a blank line has no summary unless ``skip_leading_blank``.
    """
    text = ustrip(c) if skip_leading_blank else col(c)

    def is_stop(line: Column) -> Column:
        return (line == "") | line.startswith(":")

    def leading(lines: Column, stop: Column) -> Column:
        return F.slice(lines, F.lit(1), F.when(stop == 0, F.size(lines)).otherwise(stop - 1).cast("int"))

    def block(lines: Column) -> Column:
        return once(F.array_position(F.transform(lines, is_stop), F.lit(True)), lambda stop: leading(lines, stop))

    lines = F.transform(F.split(text, LINE_BREAK, -1), ustrip)
    return F.nullif(F.array_join(once(lines, block), " "), F.lit(""))


def lower(c: Name) -> Column:
    """Lower case with the character tables of Python."""
    return once(col(c), unicode.lower)


def eq_ci(a: Name, b: Name) -> Column:
    return lower(a) == lower(b)


def commit_target(
    subject: Name,
    message: Name,
    sep: str = "\n",
    collapse: bool = True,
    empty_as_null: bool = True,
) -> Column:
    """Subject and message of a commit as one text; a message that only repeats the subject is left out."""
    subj, msg = clean(subject), clean(message)
    new_info = (msg != "") & ~eq_ci(msg, subj)
    both = F.concat(subj, F.lit(sep), msg)
    text = F.when(new_info & (subj != ""), both).when(new_info, msg).otherwise(F.coalesce(F.nullif(subj, F.lit("")), msg))
    text = collapse_ws(text) if collapse else text
    return F.nullif(text, F.lit("")) if empty_as_null else text


def target_or_fallback(
    docstring: Name | None,
    target: Name | None,
    subject: Name,
    message: Name,
    strip_first: bool = False,
    sep: str = " ",
    collapse: bool = False,
) -> Column:
    """Docstring, else target, else the text made of subject and message, else ``""``; stripped.

    With ``strip_first`` an explicit text of white space only counts as missing. Without it such a text is picked
    and strips to nothing.
    """
    explicit = [c for c in (docstring, target) if c is not None]
    made = commit_target(subject, message, sep, collapse, empty_as_null=False)
    if strip_first:
        picked = F.nullif(clean(first_nonempty(*explicit)), F.lit("")) if explicit else F.lit(None)
        return F.coalesce(picked, made)
    return clean(first_nonempty(*explicit, made))


def line_count(c: Name) -> Column:
    """Number of newline characters plus one."""
    text = col(c)
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1)


def safe_name(c: Name) -> Column:
    """Lower-case folder name; runs of unsafe characters become one underscore."""
    return F.regexp_replace(lower(c), UNSAFE_NAME, "_")


def content_hash(c: Name) -> Column:
    return F.md5(clean(c))


def change_hash(before: Name, after: Name) -> Column:
    return F.md5(F.concat(clean(before), F.lit(CHANGE_SEPARATOR), clean(after)))


def preview_text(c: Name, n: int, ellipsis: bool = False) -> Column:
    """First ``n`` characters; with ``ellipsis`` a cut text ends in three dots."""
    head = F.left(col(c), F.lit(n))
    return F.when(F.length(col(c)) > n, F.concat(head, F.lit("..."))).otherwise(head) if ellipsis else head


def starts_upper(c: Name) -> Column:
    return F.rlike(col(c), F.lit("^" + unicode.upper_char()))


def starts_alpha(c: Name) -> Column:
    return F.rlike(col(c), F.lit("^" + unicode.letter_char()))


def starts_any(c: Name, prefixes: Iterable[str]) -> Column:
    return _any(col(c).startswith(p) for p in prefixes)


def ends_sentence(c: Name) -> Column:
    return _any(col(c).endswith(mark) for mark in SENTENCE_ENDS)


def _any(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result | condition
    return F.lit(False) if result is None else result


def language_norm(c: Name, default: str = "code") -> Column:
    return lower(F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default)))


def fixed(c: Name, digits: int) -> Column:
    """A number as text with a fixed count of decimals (4 for cross-entropy, 2 for perplexity)."""
    return F.format_string(f"%.{digits}f", col(c).cast("double"))


def scientific(c: Name, digits: int = 1) -> Column:
    """A number in the ``2.0e-04`` style, used for learning rates."""
    return F.format_string(f"%.{digits}e", col(c).cast("double"))
