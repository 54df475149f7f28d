"""Chat text: rendering a row and taking rendered text apart again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ASSISTANT_TAG, END_TAG, START_TAG
from .gates import after_text, before_text
from .profiles import CHANGE_LAYOUTS, CODE_LAYOUTS, PROFILES, SYSTEM_PROMPTS, Profile
from .text import Name, clean, col, language_norm, target_or_fallback, ustrip

FENCE = "```"


def profile_of(profile: Profile | str) -> Profile:
    return PROFILES[profile] if isinstance(profile, str) else profile


def chat(system: str, user: Column, target: Column) -> Column:
    """System, user and assistant turn of one example."""
    return F.concat(
        F.lit(f"{START_TAG}system\n{system}{END_TAG}\n{START_TAG}user\n"),
        user,
        F.lit(f"{END_TAG}\n{ASSISTANT_TAG}"),
        target,
        F.lit(f"{END_TAG}\n"),
    )


def code_user(layout_name: str) -> Column:
    layout = CODE_LAYOUTS[layout_name]
    language = language_norm("language") if layout.language is None else F.lit(layout.language)
    code = clean("code") if layout.strip_code else F.col("code")
    return F.concat(
        F.lit("Language: "),
        language,
        F.lit(f"\nInstruction: {layout.instruction}\nCode:\n{FENCE}"),
        language,
        F.lit("\n"),
        code,
        F.lit(f"\n{FENCE}"),
    )


def change_user(layout_name: str) -> Column:
    layout = CHANGE_LAYOUTS[layout_name]
    return F.concat(
        F.lit(
            f"Language: {layout.language}\nInstruction: {layout.instruction}{layout.lead}"
            f"BEFORE:\n{FENCE}{layout.fence}\n"
        ),
        before_text(),
        F.lit(f"\n{FENCE}{layout.gap}AFTER:\n{FENCE}{layout.fence}\n"),
        after_text(),
        F.lit(f"\n{FENCE}"),
    )


def commit_answer(profile: Profile) -> Column:
    if profile.target == "target":
        return clean("target")
    docstring = "docstring" if profile.target == "docstring_chain" else None
    return target_or_fallback(
        docstring, "target", "subject", "message", strip_first=profile.strip_first, collapse=profile.collapse
    )


def code_answer(profile: Profile) -> Column:
    return commit_answer(profile) if profile.target == "docstring_chain" else clean("docstring")


def code_chat(profile: Profile | str) -> Column:
    p = profile_of(profile)
    return chat(SYSTEM_PROMPTS[p.system], code_user(p.code), code_answer(p))


def commit_chat(profile: Profile | str) -> Column:
    p = profile_of(profile)
    return chat(SYSTEM_PROMPTS[p.system], change_user(p.change), commit_answer(p))


def mixed_chat(profile: Profile | str) -> Column:
    """Code layout where ``code`` is not null, commit layout elsewhere."""
    return F.when(F.col("code").isNotNull(), code_chat(profile)).otherwise(commit_chat(profile))


def has_tag(text: Name) -> Column:
    return F.coalesce(F.instr(col(text), ASSISTANT_TAG) > 0, F.lit(False))


def prompt_of(text: Name) -> Column:
    """Everything up to and including the first assistant tag; null without a tag."""
    at = F.instr(col(text), ASSISTANT_TAG)
    return F.when(at > 0, F.left(col(text), at + F.lit(len(ASSISTANT_TAG) - 1)))


def prompt_end(text: Name) -> Column:
    """Code points up to the end of the first assistant tag; null without a tag."""
    at = F.instr(col(text), ASSISTANT_TAG)
    return F.when(at > 0, at + F.lit(len(ASSISTANT_TAG) - 1))


def rest_of(text: Name) -> Column:
    """Everything after the first assistant tag; null without a tag."""
    at = F.instr(col(text), ASSISTANT_TAG)
    return F.when(at > 0, F.substring(col(text), at + F.lit(len(ASSISTANT_TAG)), F.length(col(text))))


def extract_target(text: Name) -> Column:
    """The answer: what follows the first assistant tag, up to the first end tag, stripped."""
    return until_end_tag(rest_of(text))


def until_end_tag(text: Name) -> Column:
    return ustrip(F.split_part(col(text), F.lit(END_TAG), F.lit(1)))
