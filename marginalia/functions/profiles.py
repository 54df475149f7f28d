"""Prompt wording: system prompts, user layouts and the profiles that combine them."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------------------------------------
# The dash in "1–3" is U+2013.
SYSTEM_PROMPTS = {
    "code": (
        "You are a senior engineer. Summarize code for non-technical managers: "
        "plain English, 1–3 sentences, no jargon, no code, start with a verb."
    ),
    "change": (
        "You are a senior engineer. Explain the functional change between two code revisions "
        "in plain English, 1–3 sentences, no jargon, no code, start with a verb."
    ),
    "commit": (
        "You are a senior engineer. Summarize commit changes for non-technical managers: "
        "plain English, 1–3 sentences, no jargon, no code, start with a verb."
    ),
    "any": (
        "You are a senior engineer. Summarize for non-technical managers: "
        "plain English, 1–3 sentences, no jargon, no code, start with a verb."
    ),
    "changes_or_code": (
        "You are a senior engineer. Summarize changes or code for non-technical managers: "
        "plain English, 1–3 sentences, no jargon, no code, start with a verb."
    ),
    "code_or_changes": (
        "You are a senior engineer. Summarize code or code changes for non-technical managers: "
        "plain English, 1–3 sentences, no jargon, no code, start with a verb."
    ),
}

EXPLAIN_CODE = "Explain clearly and concisely what this code does."
EXPLAIN_CODE_SHORT = "Explain clearly what this code does."
EXPLAIN_CHANGE = "Explain clearly and concisely what changed between BEFORE and AFTER."
EXPLAIN_CHANGE_BRIEF = "Explain clearly what changed."
EXPLAIN_CHANGE_TIGHT = "Explain clearly what changed between BEFORE and AFTER."
EXPLAIN_CHANGE_PLAIN = "Explain what changed between BEFORE and AFTER."


@dataclass(frozen=True)
class CodeLayout:
    """User turn of a code row. ``language`` None means: take the row's own language."""

    instruction: str
    language: str | None = "python"
    strip_code: bool = True


@dataclass(frozen=True)
class ChangeLayout:
    """User turn of a commit row. ``gap`` stands between the blocks, ``lead`` before the first one."""

    instruction: str
    language: str
    fence: str
    gap: str = "\n\n"
    lead: str = "\n"


CODE_LAYOUTS = {
    "code": CodeLayout(EXPLAIN_CODE),
    "code_raw": CodeLayout(EXPLAIN_CODE, strip_code=False),
    "code_lang": CodeLayout(EXPLAIN_CODE, language=None, strip_code=False),
    "code_short": CodeLayout(EXPLAIN_CODE_SHORT),
    "code_short_raw": CodeLayout(EXPLAIN_CODE_SHORT, strip_code=False),
}

CHANGE_LAYOUTS = {
    "diff": ChangeLayout(EXPLAIN_CHANGE, "code", "diff"),
    "change_py": ChangeLayout(EXPLAIN_CHANGE, "python", "python"),
    "change_brief": ChangeLayout(EXPLAIN_CHANGE_BRIEF, "python", "python", lead="\n\n"),
    "change_tight": ChangeLayout(EXPLAIN_CHANGE_TIGHT, "python", "python", gap="\n"),
    "change_plain": ChangeLayout(EXPLAIN_CHANGE_PLAIN, "python", "python", gap="\n"),
}
# --- end of fixed values ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """How a row becomes chat text.

    ``target`` says where the answer of a commit row comes from: ``"target"`` (that column only), ``"chain"``
    (target, else subject and message) or ``"docstring_chain"`` (docstring first).
    """

    system: str
    code: str | None = None
    change: str | None = None
    target: str = "chain"
    collapse: bool = False
    strip_first: bool = False


PROFILES = {
    "mix_code": Profile("code", code="code"),
    "mix_commit": Profile("change", change="diff", collapse=True),
    "code_by_language": Profile("code", code="code_lang"),
    "code_python_raw": Profile("code", code="code_raw"),
    "models_code": Profile("code", code="code_short_raw"),
    "commit_brief": Profile("commit", change="change_brief", target="target"),
    "commit_sweep": Profile("change", change="change_py"),
    "models_commit": Profile("change", change="diff"),
    "models_mixed": Profile("any", code="code", change="change_py"),
    "final_mixed": Profile(
        "changes_or_code", code="code_short", change="change_tight", target="docstring_chain", strip_first=True
    ),
    "final_code": Profile("code_or_changes", code="code"),
    "final_commit": Profile("code_or_changes", change="change_plain", strip_first=True),
}
