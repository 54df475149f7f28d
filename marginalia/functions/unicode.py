"""Character classes as Python's string methods have them, for native expressions.

The engine's own tables follow other Unicode versions. These are built from Python's by rule: ranges of code points for a
pattern, pairs of characters for a translation. The driver builds each once; the executors see literals.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = 0x10FFFF
SURROGATES = range(0xD800, 0xE000)
FINAL_SIGMA = "Σ"  # its lower case depends on the letters around it, which the built-in function knows


def _others() -> list[str]:
    return [chr(i) for i in range(0x80, LAST + 1) if i not in SURROGATES]


@cache
def ranges(test: Callable[[str], bool]) -> tuple[tuple[int, int], ...]:
    """Ranges of the code points beyond ASCII that pass ``test`` (a method of ``str``)."""
    out: list[list[int]] = []
    for c in filter(test, _others()):
        if out and out[-1][1] == ord(c) - 1:
            out[-1][1] = ord(c)
        else:
            out.append([ord(c), ord(c)])
    return tuple((a, b) for a, b in out)


@cache
def one_of(ascii_class: str, test: Callable[[str], bool]) -> str:
    """A pattern for one character: of ``ascii_class``, or beyond ASCII and passing ``test``."""
    wide = "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges(test))
    return f"(?:[{ascii_class}]|(?![\\x00-\\x7f])[{wide}])"


def upper_char() -> str:
    return one_of("A-Z", str.isupper)


def letter_char() -> str:
    return one_of("A-Za-z", str.isalpha)


@cache
def lower_pairs() -> tuple[str, str]:
    """Characters with a lower case of one character that does not depend on others, and those."""
    letters = [*string.ascii_uppercase, *_others()]
    pairs = [(c, c.lower()) for c in letters if c != FINAL_SIGMA and c.lower() != c and len(c.lower()) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def lower(c: Column) -> Column:
    """Lower case as ``str.lower``. Plain ASCII, by far the most, takes the short way.

    A text with a capital sigma goes through the built-in function too, which may know letters that Python does not.
    """
    upper, made = lower_pairs()
    translated = F.translate(c, upper, made)
    dotted = F.replace(translated, F.lit("\u0130"), F.lit("\u0130".lower()))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).when(c.contains(FINAL_SIGMA), F.lower(translated)).otherwise(dotted)
