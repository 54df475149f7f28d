"""Fixed values shared by the whole library.

They are part of the results (seeds, quotas, bounds, prompt wording), so they are stated once, here and in
``functions/profiles.py``, and only referred to elsewhere.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------------------------------
SEED = 42

SPLITS = ("train", "validation", "test")
QUOTAS = {"train": 2100, "validation": 300, "test": 600}
MIX_TOTALS = {"train": 2100, "validation": 300, "test": 600}
TINY_SLICES = {"train": 16, "validation": 8}

COMMIT_LANGUAGES = ("python", "java", "javascript", "go", "ruby", "php")
DEFAULT_LANGUAGE = "code"

CODE_INSTRUCTION = "Explain what the following code does."
COMMIT_INSTRUCTION = "Explain, in plain English, what functionality changed between these two commits."

MIN_LINES, MAX_LINES = 3, 350
CHANGE_SEPARATOR = "\n<SEP>\n"

MAX_TOKENS = 1536
IGNORE_LABEL = -100
EVAL_BATCH_SIZE = 2
LOSS_EPSILON = 1e-9
PERPLEXITY_LIMIT = 20.0

START_TAG = "<|im_start|>"
END_TAG = "<|im_end|>"
ASSISTANT_TAG = "<|im_start|>assistant\n"

WEAK_SUMMARY_STARTS = ("See", "Refer")
WEAK_COMMIT_STARTS = (
    "Merge branch",
    "Merge pull request",
    "WIP",
    "Temp",
    "Test",
    "Update README",
    "Bump version",
    "Release",
)
SENTENCE_ENDS = (".", "?", "!")

# Unicode whitespace: the 29 code points a Unicode-aware strip removes, and the same set as a Java regex class.
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
UNSAFE_NAME = r"[^a-zA-Z0-9_+-]+"
# --- end of fixed values ----------------------------------------------------------------------------------

# Largest k for which a per-group row limit is planned as WindowGroupLimit once ``session.configure`` has run.
GROUP_LIMIT_THRESHOLD = 10_000
# Side tables are broadcast only if their proved row bound is at most this many rows.
BROADCAST_ROW_BOUND = 200_000
