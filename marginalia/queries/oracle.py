"""The same queries as SQL for DuckDB, written from the rules and not from the Spark code.

Every query is a chain of named steps (common table expressions); ``sql`` adds those a query needs.
"""

from __future__ import annotations

import re

from ..constants import UNICODE_SPACES
from ..functions.profiles import (
    EXPLAIN_CHANGE,
    EXPLAIN_CHANGE_BRIEF,
    EXPLAIN_CHANGE_PLAIN,
    EXPLAIN_CHANGE_TIGHT,
    EXPLAIN_CODE,
    EXPLAIN_CODE_SHORT,
    SYSTEM_PROMPTS,
)

NL = "chr(10)"
WS = "(" + "||".join(f"chr({ord(c)})" for c in UNICODE_SPACES) + ")"
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKENS = r"<\|im_start\|>|<\|im_end\|>|\n|[\p{L}\p{N}_]+|[^ \t\r\f\x0b\n\p{L}\p{N}_]"
TAG = "<|im_start|>assistant\n"
MATERIALIZED = ("chat_tokens", "vocab", "corpora_tokens", "corpora_vocab", "labels", "fit")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPT = f"len(regexp_extract_all(text[1:instr(text, {lit(TAG)}) + {len(TAG) - 1}], '{TOKENS}'))"


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {WS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def nonempty(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ")"


def summary(doc: str) -> str:
    lines = f"list_transform(regexp_split_to_array({doc}, '{BREAKS}'), lambda l: trim(l, {WS}))"
    stop = f"list_position(list_transform({lines}, lambda l: l = '' or starts_with(l, ':')), true)"
    return f"nullif(array_to_string(({lines})[1:coalesce({stop} - 1, len({lines}))], ' '), '')"


def made(sep: str, do_collapse: bool, subj: str = "subject", msg: str = "message") -> str:
    """Subject and message as one text, ``''`` if there is none."""
    s, m = strip(subj), strip(msg)
    text = (
        f"case when {m} <> '' and lower({m}) <> lower({s}) then case when {s} <> '' then {s} || {sep} || {m} else {m} end "
        f"else coalesce(nullif({s}, ''), {m}) end"
    )
    return collapse(f"({text})") if do_collapse else f"({text})"


def target(*explicit: str, do_collapse: bool = False, strip_first: bool = False) -> str:
    made_up = made("' '", do_collapse)
    if strip_first:
        return f"coalesce(nullif({strip(nonempty(*explicit))}, ''), {made_up})"
    return strip(f"coalesce({nonempty(*explicit)}, {made_up})")


def lines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {NL}, '')) + 1)"


def ends(x: str) -> str:
    return f"({x} like '%.' or {x} like '%?' or {x} like '%!')"


def sentence(x: str, n: int, weak: tuple[str, ...]) -> str:
    starts = " or ".join(f"starts_with({x}, {lit(w)})" for w in weak)
    return f"coalesce(length({x}) >= {n} and regexp_matches({x}, '^\\p{{Lu}}') and {ends(x)} and not ({starts}), false)"


def wordy(x: str, n: int = 10) -> str:
    return f"(length({x}) >= {n} and regexp_matches({x}, '^\\p{{L}}'))"


WEAK_SUMMARY = ("See", "Refer")
WEAK_COMMIT = ("Merge branch", "Merge pull request", "WIP", "Temp", "Test", "Update README", "Bump version", "Release")
BEFORE = strip(nonempty("old_code", "old_contents"))
AFTER = strip(nonempty("new_code", "new_contents"))
G1 = sentence("summary", 30, WEAK_SUMMARY)
G3 = f"coalesce(code <> '' and {lines('code')} between 3 and 350, false)"
G5 = f"(length({strip('code')}) >= 10 and length({strip('docstring')}) >= 10)"
G6 = f"(length({BEFORE}) >= 10 and length({AFTER}) >= 10 and length({target('target', do_collapse=True)}) >= 10)"
G7 = wordy(strip("docstring"))
G9 = f"({BEFORE} <> '' and {AFTER} <> '' and length({target('target')}) >= 10)"
G10 = (
    f"case when code is not null then {wordy(strip('docstring'))} "
    f"else {BEFORE} <> '' and {AFTER} <> '' and {wordy(target('target'))} end"
)
G11 = f"(length({target('docstring', 'target', strip_first=True)}) >= 8)"


def chat(system: str, user: str, answer: str) -> str:
    return (
        f"{lit('<|im_start|>system' + chr(10) + SYSTEM_PROMPTS[system] + '<|im_end|>' + chr(10) + '<|im_start|>user' + chr(10))}"
        f" || {user} || {lit('<|im_end|>' + chr(10) + TAG)} || {answer} || {lit('<|im_end|>' + chr(10))}"
    )


def code_user(instruction: str, code: str, language: str = "'python'") -> str:
    return (
        f"('Language: ' || {language} || {lit(chr(10) + 'Instruction: ' + instruction + chr(10) + 'Code:' + chr(10) + '```')}"
        f" || {language} || {NL} || {code} || {lit(chr(10) + '```')})"
    )


def change_user(language: str, instruction: str, fence: str, lead: str, gap: str) -> str:
    head = f"Language: {language}\nInstruction: {instruction}{lead}BEFORE:\n```{fence}\n"
    return f"({lit(head)} || {BEFORE} || {lit(f'{chr(10)}```{gap}AFTER:{chr(10)}```{fence}{chr(10)}')} || {AFTER} || {lit(chr(10) + '```')})"


LANG = "lower(coalesce(nullif(language, ''), 'code'))"
DOC, CODE = strip("docstring"), strip("code")
CODE_CHATS = {
    "mix_code": chat("code", code_user(EXPLAIN_CODE, CODE), DOC),
    "code_by_language": chat("code", code_user(EXPLAIN_CODE, "code", LANG), DOC),
    "code_python_raw": chat("code", code_user(EXPLAIN_CODE, "code"), DOC),
    "models_code": chat("code", code_user(EXPLAIN_CODE_SHORT, "code"), DOC),
    "final_code": chat("code_or_changes", code_user(EXPLAIN_CODE, CODE), DOC),
}
COMMIT_CHATS = {
    "mix_commit": chat("change", change_user("code", EXPLAIN_CHANGE, "diff", "\n", "\n\n"), target("target", do_collapse=True)),
    "commit_brief": chat("commit", change_user("python", EXPLAIN_CHANGE_BRIEF, "python", "\n\n", "\n\n"), strip("target")),
    "commit_sweep": chat("change", change_user("python", EXPLAIN_CHANGE, "python", "\n", "\n\n"), target("target")),
    "models_commit": chat("change", change_user("code", EXPLAIN_CHANGE, "diff", "\n", "\n\n"), target("target")),
    "final_commit": chat(
        "code_or_changes", change_user("python", EXPLAIN_CHANGE_PLAIN, "python", "\n", "\n"), target("target", strip_first=True)
    ),
}
FINAL_ANSWER = target("docstring", "target", strip_first=True)
MIXED_CHATS = {
    "models_mixed": "case when code is not null then "
    + chat("any", code_user(EXPLAIN_CODE, CODE), DOC)
    + " else "
    + chat("any", change_user("python", EXPLAIN_CHANGE, "python", "\n", "\n\n"), target("target"))
    + " end",
    "final_mixed": "case when code is not null then "
    + chat("changes_or_code", code_user(EXPLAIN_CODE_SHORT, CODE), FINAL_ANSWER)
    + " else "
    + chat("changes_or_code", change_user("python", EXPLAIN_CHANGE_TIGHT, "python", "\n", "\n"), FINAL_ANSWER)
    + " end",
}


def split_of(rows: str) -> str:
    return f"""select * exclude (r, n), case when r*10 < 7*n - (7*n)%10 then 'train'
      when r*10 < 8*n - (8*n)%10 then 'validation' else 'test' end as split
    from (select *, row_number() over (partition by language order by md5('42:' || ord), ord) - 1 as r,
                 count(*) over (partition by language) as n from {rows})"""


def compacted(rows: str, gate: str, hashed: str, quotas: dict[str, int]) -> str:
    quota = "case split " + " ".join(f"when '{s}' then {q}" for s, q in quotas.items()) + " end"
    return f"""select * exclude (h, dup, rn) from (
      select *, row_number() over (partition by language, split order by md5('42:' || ord), ord) as rn from (
        select *, row_number() over (partition by language, split, h order by ord) as dup
        from (select *, {hashed} as h from {rows} where {gate})) where dup = 1) where rn <= {quota}"""


def quota_sample(rows: str, quotas: dict[str, int]) -> str:
    quota = "case split " + " ".join(f"when '{s}' then {q}" for s, q in quotas.items()) + " else 0 end"
    return f"""select * exclude (rn) from (select *, row_number() over (partition by split order by md5('42:' || ord), ord) as rn
      from {rows}) where rn <= {quota}"""


QUOTAS = {"train": 2100, "validation": 300, "test": 600}
SMALL = {"train": 100, "validation": 10, "test": 20}
CODE_HASH = f"md5({CODE})"
PAIR_HASH = "md5({} || chr(10) || '<SEP>' || chr(10) || {})"
MADE_TARGET = f"nullif({made(NL, True)}, '')"


def mixed_sample(quota: dict[str, int], code_share: int, commit_share: int) -> str:
    part = {k: {s: t * share // 100 for s, t in quota.items()} for k, share in (("code", code_share), ("commit", commit_share))}
    return f"""select ord, split, text, source,
      row_number() over (partition by split order by md5('42:' || source || ':' || ord), source || ':' || ord) as shuffle_pos
      from (select ord, split, text, 'code' as source from ({quota_sample('code_chat', part['code'])})
            union all select ord, split, text, 'commit' from ({quota_sample('commit_chat', part['commit'])}))"""


STEPS = {
    "code_rows": """select doc_id as ord, lang as language, text as code, case cast(doc_id % 4 as int)
        when 0 then split_part(text, chr(10), 1) || chr(10) || chr(10) || text
        when 1 then split_part(text, chr(10), 1) || chr(10) || ':param x: value'
        when 2 then split_part(text, chr(10), 1) else chr(10) || text end as docstring from documents""",
    "commit_rows": """select conv_id*1000000 + g as ord, case cast(conv_id % 6 as int) when 0 then 'go' when 1 then 'java'
        when 2 then 'javascript' when 3 then 'php' when 4 then 'python' else 'ruby' end as language,
        max(case when q=0 then text end) as subject, max(case when q=1 then text end) as old_contents,
        max(case when q=2 then text end) as message, max(case when q=3 then text end) as new_contents
      from (select conv_id, text, cast(floor((p-1)/4) as bigint) as g, cast((p-1)%4 as int) as q
        from (select conv_id, text, row_number() over (partition by conv_id order by turn) as p
              from conversations where role <> 'system')) group by conv_id, g""",
    "log_rows": """select cast(user_id % 4 as int) as run, event_id as idx,
        case when event_type in ('error','signup') then null else cast(event_id as int) end as step,
        case when event_type='click' then value end as loss,
        case when event_type in ('view','error') then value end as eval_loss,
        case when event_type='purchase' then value/1000 end as learning_rate,
        case when event_type in ('signup','view') then cast(floor(event_id/1000) as double) end as epoch from events""",
    "code_split": split_of("code_rows"),
    "commit_split": split_of("commit_rows"),
    "summaries": f"select *, {summary('docstring')} as summary from code_split",
    "normal": f"""select ord, language, {strip('old_contents')} as old_code, {strip('new_contents')} as new_code,
        cast(null as varchar) as old_contents, cast(null as varchar) as new_contents,
        {strip('message')} as message, {strip('subject')} as subject, {MADE_TARGET} as target from commit_rows""",
    "normal_split": f"""select ord, language, split, {strip('old_contents')} as old_code, {strip('new_contents')} as new_code,
        {strip('message')} as message, {strip('subject')} as subject, {MADE_TARGET} as target from commit_split""",
    "mixed": """select 'code' as source, ord, language, code, docstring, null as old_contents, null as new_contents, null as subject,
        null as message, null as target, null as old_code, null as new_code from code_rows
      union all select 'commit', ord, language, null, null, old_contents, new_contents, subject, message, null, null, null
      from commit_rows""",
    "mixed_split": """select 'code' as source, ord, language, split, code, docstring, null as old_contents, null as new_contents,
        null as subject, null as message, null as target, null as old_code, null as new_code from code_split
      union all select 'commit', ord, language, split, null, null, old_contents, new_contents, subject, message, null, null, null
      from commit_split""",
    "cleaned_code": f"select ord, language, split, code, summary as docstring from summaries where {G1}",
    "cleaned_commit": f"select * from normal_split where {sentence('target', 20, WEAK_COMMIT)}",
    "code_chat": f"select ord, language, split, {CODE_CHATS['mix_code']} as text from code_split where {G5}",
    "commit_chat": f"""select ord, language, split, {COMMIT_CHATS['mix_commit']} as text
      from (select *, null as old_code, null as new_code, cast(null as varchar) as target from commit_split) where {G6}""",
    # One corpus as chat text by language.
    "chats": f"select ord, {LANG} as language, split, {CODE_CHATS['code_by_language']} as text from code_split",
    "chat_tokens": f"select *, regexp_extract_all(text, '{TOKENS}') as toks, {PROMPT} as prompt from chats",
    "vocab": f"""select token, cast(row_number() over (order by n desc, token) + 1 as int) as id, n as count from (
        select token, count(*) as n from (select unnest(toks) as token from chat_tokens where split = 'train')
        group by token order by n desc, token)""",
    "mixed_texts": """select ord, text from chats union all select -ord - 1, docstring from code_rows""",
    # Both corpora.
    "corpora": """select 'code' as dataset, language, split, ord as row_id, text from code_chat
      union all select 'commit', language, split, ord, text from commit_chat""",
    "corpora_tokens": f"select *, regexp_extract_all(text, '{TOKENS}') as toks, {PROMPT} as prompt from corpora",
    "corpora_vocab": f"""select token, cast(row_number() over (order by n desc, token) + 1 as int) as id from (
        select token, count(*) as n from (select unnest(toks) as token from corpora_tokens where split = 'train')
        group by token order by n desc, token)""",
    # One row per position: the label at pos is scored by the loss at pos - 1 (0-based, position 0 has none).
    "labels": """select dataset, language, split, row_id, pos,
        case when pos < prompt then -100 else cast(coalesce(v.id, 1) as int) end as label from (
          select dataset, language, split, row_id, unnest(toks[1:1536]) as token,
            generate_subscripts(toks[1:1536], 1) - 1 as pos, prompt from corpora_tokens) t left join corpora_vocab v using (token)""",
    "fit": "select label, count(*) as n from labels where split = 'train' and label <> -100 group by label",
    "losses": f"""select l.*, m.model, case when label = -100 then 0.0 when m.model = 'uniform' then ln((select count(*) + 2 from corpora_vocab)::double)
        else -ln((coalesce(f.n, 0) + 1.0) / ((select sum(n) from fit) + 1.0 * (select count(*) + 2 from corpora_vocab))) end as loss
      from (select dataset, language, split, row_id, cast(pos - 1 as int) as pos, label from labels
            where pos > 0 and split <> 'train') l
      left join fit f using (label) cross join (select unnest(['unigram', 'uniform']) as model) m""",
    "row_losses": """select dataset, language, split, row_id, model, count(*) filter (where label <> -100) as tokens,
        sum(loss) / (count(*) filter (where label <> -100) + 1e-9) as row_loss from losses
      group by dataset, language, split, row_id, model""",
    "run_metrics": """select 'run' || run as key, case when evals >= points * 2 then 'ok' else 'failed' end as status,
        round(ce, 6) as val_ce, case when evals >= points * 2 then round(ev, 6) end as test_ce from (
        select run, avg(loss) as ce, avg(eval_loss) as ev, count(loss) as points, count(eval_loss) as evals
        from log_rows group by run)""",
    "steps": """select *, coalesce(step, greatest(coalesce(max(step) over (partition by run order by idx
        rows between unbounded preceding and 1 preceding), 0), 0)) as filled from log_rows""",
}


def needs(text: str) -> list[str]:
    found = [s for s in STEPS if re.search(rf"\b{s}\b", text)]
    return found


def sql(final: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in needs(STEPS[name]):
            if other != name and other not in order:
                visit(other)
        if name not in order:
            order.append(name)

    for name in needs(final):
        visit(name)
    steps = ",\n".join(f"{n} as {'materialized ' if n in MATERIALIZED else ''}({STEPS[n]})" for n in order)
    return f"with {steps}\n{final}" if steps else final


def matrix(rows: str) -> str:
    cols = ", ".join(f"count(*) filter (where split = '{s}') as {s}" for s in ("train", "validation", "test"))
    return f"select language, {cols} from ({rows}) group by language"


def curve(metric: str, step: str) -> str:
    return f"select run, idx, '{metric}' as metric, {step} as step, {metric} as value from steps where {metric} is not null"


ENCODED = """select t.ord, array_to_string(list(coalesce(v.id, 1) order by pos), ',') as input_ids,
  array_to_string(list(1 order by pos), ',') as attention_mask
  from (select ord, unnest(toks[1:1536]) as token, generate_subscripts(toks[1:1536], 1) as pos from chat_tokens) t
  left join vocab v using (token) group by t.ord"""
MASKED = """select ord, list(id order by pos) as ids, list(1 order by pos) as ones,
  list(case when pos <= prompt then -100 else id end order by pos) as labels from (
  select t.*, coalesce(v.id, 1) as id from (
    select ord, unnest(toks[1:1536]) as token, generate_subscripts(toks[1:1536], 1) as pos, prompt from chat_tokens) t
  left join vocab v using (token)) group by ord"""
SIZED = "select language, split, len(toks) as tokens, prompt from chat_tokens"
BATCHED = "select ord, split, (row_number() over (partition by split order by ord) - 1) // 2 as batch_id from code_split"
PAD = "{} || list_transform(range(m - len(ids)), lambda i: {})"


def scores(by: str, where: str = "true") -> str:
    return f"""select {by}, count(*) as count, round(avg(row_loss), 6) as avg_ce,
      round(case when avg(row_loss) < 20 then exp(avg(row_loss)) else 'infinity'::double end, 6) as perplexity
      from row_losses where {where} group by {by}"""


QUERIES = {
    "c1_summary": f"select ord, {summary('docstring')} as summary from code_rows",
    "c1_summary_skip_blank": f"select ord, {summary(f'trim(docstring, {WS})')} as summary from code_rows",
    "c2_commit_target_newline": f"select ord, nullif({made(NL, False)}, '') as target from commit_rows",
    "c2_commit_target_space": f"""select ord, {made("' '", True)} as target from commit_rows""",
    "c3_fallback": f"""select source, ord, {target('docstring', 'new_contents')} as target,
        {target('docstring', 'new_contents', strip_first=True)} as target_strip_first from mixed""",
    "c4_collapse_ws": f"select ord, {collapse('docstring')} as collapsed from code_rows",
    "c5_ustrip": f"select ord, trim(docstring, {WS}) as stripped from code_rows",
    "c6_line_count": f"select ord, cast({lines('code')} as int) as lines from code_rows",
    "c7_safe_name": """select regexp_replace(lower(upper(lang) || '/ ' || source), '[^a-zA-Z0-9_+-]+', '_', 'g') as folder,
        count(*) as count from documents group by 1""",
    "c8_content_hash": f"select ord, {CODE_HASH} as hash from code_rows",
    "c8_change_hash": f"select ord, {PAIR_HASH.format(strip('old_contents'), strip('new_contents'))} as hash from commit_rows",
    "c9_preview": """select ord, left(code, 800) as head,
        left(code, 400) || case when length(code) > 400 then '...' else '' end as cut from code_rows""",
    "c10_format": """select run, printf('%.4f', avg(loss)) as ce, printf('%.2f', avg(eval_loss)) as ppl,
        printf('%.1e', avg(learning_rate)) as lr, round(avg(loss), 6) as rounded from log_rows group by run""",
    "c11_char_tests": f"""select ord, regexp_matches(s, '^\\p{{Lu}}') as upper, regexp_matches(s, '^\\p{{L}}') as alpha,
        {ends('s')} as sentence, (starts_with(s, 'The') or starts_with(s, 'In') or starts_with(s, 'La')) as prefix,
        cast(length(s) as int) as chars from (select ord, {summary(f'trim(docstring, {WS})')} as s from code_rows)""",
    "c12_eq_ci": """select ord, lower(subject) = lower(message) as same, lower(subject) as lowered
        from commit_rows""",
    "g1_good_summary": f"select ord, {G1} as ok from summaries",
    "g2_good_commit": f"""select ord, {sentence('target', 20, WEAK_COMMIT)} as ok from
        (select ord, {MADE_TARGET} as target from commit_rows)""",
    "g3_code_length": f"select ord, {G3} as ok from code_rows",
    "g4_change_length": f"""select ord, {lines("coalesce(old_contents, '')")} + {lines("coalesce(new_contents, '')")}
        between 3 and 350 as ok from commit_rows""",
    "g5_code_row": f"select ord, {G5} as ok from code_rows",
    "g6_commit_row": f"select ord, {G6} as ok from normal",
    "g7_good_doc": f"select ord, {G7} as ok from code_rows",
    "g8_good_target": f"select ord, {wordy(strip('target'))} as ok from normal",
    "g9_min_fields": f"select ord, {G9} as ok from normal",
    "g10_mixed_row": f"select source, ord, {G10} as ok from mixed",
    "g11_relaxed": f"select source, ord, {G11} as ok from mixed",
    "g12_gate_or_all": f"""select ord, split from (select ord, split, ok, bool_or(ok) over (partition by split) as passes from
        (select *, {G1} and split <> 'test' as ok from summaries)) where ok or not passes""",
    "g13_for_language": "select ord, language, code from code_rows where language = 'fr'",
    "g14_gate_report": f"""select split, count(*) as rows, count(*) filter (where {G1}) as good_summary,
        count(*) filter (where {G3}) as code_length, count(*) filter (where {G5}) as code_row,
        count(*) filter (where {G7}) as good_doc from summaries group by split""",
    "p1_code": """select ord, 'Explain what the following code does.' as instruction, code, coalesce(docstring, '') as docstring,
        language from code_rows""",
    "p2_commit": f"""select ord, 'Explain, in plain English, what functionality changed between these two commits.' as instruction,
        {strip('old_contents')} as old_code, {strip('new_contents')} as new_code, language, {strip('message')} as message,
        {strip('subject')} as subject from commit_rows""",
    "p3_tag": "select item_id, text, 'python' as language from benchmark",
    "p4_keep": "select ord, language from code_rows",
    "p5_encode": """select ord, language, cast(dense_rank() over (order by language) - 1 as int) as code from code_rows""",
    "p5_decode": "select ord, language from code_rows",
    "p6_first_nonempty": f"select ord, {nonempty('new_contents', 'message', 'subject')} as picked from commit_rows",
    "p7_language_norm": """select source, ord, lower(coalesce(nullif(case when source = 'code' then upper(language) end, ''), 'code'))
        as language_norm from mixed""",
    "p8_with_text": f"select *, {CODE_CHATS['code_by_language']} as text, {LANG} as language_norm from code_rows",
    "d1_dedup_first": f"""select ord, language, split, code from (select *, row_number() over
        (partition by language, split, {CODE_HASH} order by ord) as rn from code_split) where rn = 1""",
    "d1_first_keys": f"select language, split, min(ord) as ord from code_split group by language, split, {CODE_HASH}",
    "d2_sample_k": """select ord, language, code from (select *, row_number() over
        (partition by language order by md5('42:' || ord), ord) as rn from code_rows) where rn <= 50""",
    "d3_compact_code": f"select ord, language, split, code from ({compacted('code_split', G3, CODE_HASH, QUOTAS)})",
    "d3_compact_code_small": f"select ord, language, split, code from ({compacted('code_split', G3, CODE_HASH, SMALL)})",
    "d3_compact_commit": "select ord, language, split, target from ("
    + compacted("cleaned_commit", f"{lines('old_code')} + {lines('new_code')} between 3 and 350", PAIR_HASH.format("old_code", "new_code"), SMALL)
    + ")",
    "d4_stratified": "select ord, language, split from code_split",
    "d4_stratified_commit": "select ord, language, split from commit_split",
    "d5_split_sizes": "select language, split, count(*) as count from code_split group by language, split",
    "d6_shuffle_pos": "select ord, language, row_number() over (order by md5('42:' || ord), ord) as shuffle_pos from code_rows",
    "d6_shuffle_rows": "select ord, code from code_rows order by md5('42:' || ord), ord",
    "d7_sample_preview": """select ord, left(code, 800) as code, left(docstring, 800) as docstring
        from (select * from code_rows order by md5('42:' || ord), ord limit 3)""",
    "d8_head": "select * from code_rows order by ord limit 10",
    "d9_tiny_slice": f"select ord, split, docstring from ({quota_sample(f'(select * from code_split where {G7})', {'train': 16, 'validation': 8})})",
    "d10_mix_50_50": mixed_sample(QUOTAS, 50, 50),
    "d10_mix_70_30": mixed_sample(SMALL, 70, 30),
    "u1_concat": "select doc_id as id, text from documents union all select item_id, text from benchmark",
    "u2_distinct": "select language from code_rows union select language from commit_rows",
    "u3_sorted": f"select distinct source from documents where {strip('source')} <> '' order by source",
    "a1_top": "select source, count(*) as count from documents group by source order by count desc, source limit 10",
    "a2_counts": "select language, count(*) as count from code_rows where language is not null group by language",
    "a3_distribution": "select split, language, count(*) as count from code_split group by split, language",
    "a4_splits": "select split, count(*) as count from code_split group by split",
    "a5_matrix": matrix("select * from code_split"),
    "a5_matrix_totals": matrix("select * from code_split").replace("group by language", "group by rollup(language)"),
    "a6_norm_counts": f"select {LANG} as language_norm, count(*) as count from code_rows group by 1",
    "code_corpus_counts": matrix(compacted("cleaned_code", G3, CODE_HASH, QUOTAS)),
    "commit_corpus_counts": matrix(
        compacted("cleaned_commit", f"{lines('old_code')} + {lines('new_code')} between 3 and 350", PAIR_HASH.format("old_code", "new_code"), QUOTAS)
    ),
    **{f"r1_{p}": f"select ord, language, {x} as text from code_rows" for p, x in CODE_CHATS.items()},
    **{f"r2_{p}": f"select ord, language, {x} as text from normal" for p, x in COMMIT_CHATS.items()},
    **{f"r3_{p}": f"select ord, source, language, {x} as text from mixed" for p, x in MIXED_CHATS.items()},
    "r4_ensure": f"""select ord, source, split, language, {MIXED_CHATS['final_mixed']} as text from (
        select *, bool_or(ok) over (partition by split) as passes from (
          select *, {G11} and split <> 'validation' as ok from mixed_split)) where ok or not passes""",
    "r5_check": f"""select * from (select ord, {CODE_CHATS['mix_code']} as text from code_rows
        union all select -ord - 1, docstring from code_rows) where instr(text, {lit(TAG)}) = 0""",
    "r6_prompt": f"""select ord, text[1:instr(text, {lit(TAG)}) + {len(TAG) - 1}] as prompt,
        text[instr(text, {lit(TAG)}) + {len(TAG)}:] as rest from (select ord, {CODE_CHATS['mix_code']} as text from code_rows)""",
    "r7_target": f"select ord, trim(split_part({DOC}, '<|im_end|>', 1), {WS}) as target from code_rows",
    "r8_pairs": f"""select ord, left(t, 400) || case when length(t) > 400 then '...' else '' end as truth,
        left(p, 400) || case when length(p) > 400 then '...' else '' end as prediction, p = t as exact from (
        select ord, trim(split_part({DOC}, '<|im_end|>', 1), {WS}) as t, trim(split_part(code, chr(10), 1), {WS}) as p from code_rows)""",
    "t0_vocab": "select token, id, count from vocab union all select '<pad>', 0, 0 union all select '<unk>', 1, 0",
    "t1_tokenize": ENCODED,
    "t2_mask": f"select ord, array_to_string(labels, ',') as labels from ({MASKED})",
    "t3_no_tag": f"""select ord, array_to_string(list(case when pos <= prompt then -100 else id end order by pos), ',') as labels from (
        select t.*, coalesce(v.id, 1) as id from (
          select ord, unnest(toks[1:1536]) as token, generate_subscripts(toks[1:1536], 1) as pos, prompt from (
            select ord, regexp_extract_all(text, '{TOKENS}') as toks, case when instr(text, {lit(TAG)}) = 0 then 1536
              else len(regexp_extract_all(text[1:instr(text, {lit(TAG)}) + {len(TAG) - 1}], '{TOKENS}')) end as prompt
            from mixed_texts)) t left join vocab v using (token)) group by ord""",
    "t4_batches": BATCHED,
    "t5_pad": f"""select ord, split, batch_id, array_to_string({PAD.format('ids', '0')}, ',') as input_ids,
        array_to_string({PAD.format('ones', '0')}, ',') as attention_mask, array_to_string({PAD.format('labels', '-100')}, ',') as labels
        from (select *, max(len(ids)) over (partition by split, batch_id) as m from ({MASKED}) a join ({BATCHED}) b using (ord))""",
    "t6_arrays_only": f"""select ord, array_to_string(ids, ',') as input_ids, array_to_string(ones, ',') as attention_mask,
        array_to_string(labels, ',') as labels from ({MASKED})""",
    "t7_profile": f"""select language, split, count(*) as rows, round(avg(tokens), 6) as avg_tokens, cast(max(tokens) as int) as max_tokens,
        round(avg(prompt), 6) as avg_prompt_tokens, round(avg(tokens - prompt), 6) as avg_target_tokens,
        round(avg(case when tokens > 1536 then 1 else 0 end), 6) as share_truncated,
        round(avg(case when least(prompt, 1536) >= least(tokens, 1536) then 1 else 0 end), 6) as share_without_label
        from ({SIZED}) group by language, split""",
    "e0_losses": """select dataset, language, split, row_id, pos, label, model, round(loss, 6) as loss from losses""",
    "e1_shift": """select dataset, row_id, array_to_string(list(label order by pos), ',') as labels from labels
        where pos > 0 and split <> 'train' group by dataset, row_id""",
    "e2_row_loss": "select model, dataset, language, split, row_id, round(row_loss, 6) as row_loss, tokens from row_losses",
    "e2_row_loss_arrays": """select dataset, language, split, row_id, cast(tokens as int) as tokens, model, round(row_loss, 6) as row_loss
        from row_losses""",
    "e3_ce_ppl": scores("model, split"),
    "e4_language": scores("model, language", "split = 'test' and trim(language) <> ''"),
    "e5_dataset": scores("model, dataset", "split = 'test'"),
    "e6_models": """select model, round(v, 6) as val_ce, round(exp(v), 6) as val_ppl, round(t, 6) as test_ce, round(exp(t), 6) as test_ppl
        from (select model, avg(row_loss) filter (where split = 'validation') as v, avg(row_loss) filter (where split = 'test') as t
              from row_losses group by model)""",
    "e7_compare": """select dataset, round(b, 6) as base_ce, round(t, 6) as tuned_ce, round(t - b, 6) as difference from (
        select dataset, avg(row_loss) filter (where model = 'uniform') as b, avg(row_loss) filter (where model = 'unigram') as t
        from row_losses where split = 'test' group by dataset)""",
    "l1_curves": " union all ".join(curve(m, "filled") for m in ("loss", "eval_loss", "learning_rate")),
    "l2_metric": "select run, step, eval_loss as value from log_rows where eval_loss is not null",
    "l3_epochs": "select distinct run, filled as step from steps where epoch is not null and eval_loss is not null",
    "l4_last": """select run, idx, step, round(loss, 6) as loss, round(eval_loss, 6) as eval_loss,
        round(learning_rate, 6) as learning_rate, round(epoch, 6) as epoch from (
        select *, row_number() over (partition by run order by idx desc) as rn from log_rows where loss is not null) where rn <= 10""",
    "l5_overlay": " union all ".join(
        f"select run, step, {m} as value, '{m}' as curve from log_rows where {m} is not null" for m in ("loss", "eval_loss", "learning_rate")
    ),
    "l6_grid": """select language, count, epochs, learning_rate, 2 as batch_size from
        (select language, count(*) as count from code_rows where language is not null group by language)
        cross join (select unnest([1, 2, 3]) as epochs)
        cross join (select unnest([5e-5::double, 1e-4::double, 2e-4::double, 3e-4::double]) as learning_rate)""",
    "l7_sweep": f"""select split, alpha, count(*) as count, round(avg(row_loss), 6) as avg_ce, round(exp(avg(row_loss)), 6) as perplexity
        from (select split, alpha, row_id, dataset, sum(case when label = -100 then 0.0 else
            -ln((coalesce(n, 0) + alpha) / ((select sum(n) from fit) + alpha * (select count(*) + 2 from corpora_vocab))) end)
            / (count(*) filter (where label <> -100) + 1e-9) as row_loss
          from (select * from labels where pos > 0 and split <> 'train') left join fit using (label)
          cross join (select unnest([0.1::double, 1.0::double, 10.0::double]) as alpha) group by split, alpha, row_id, dataset)
        group by split, alpha""",
    "l8_ok": "select * from run_metrics where status = 'ok'",
    "l9_best": """select status, key, val_ce, test_ce from (select *, row_number() over (partition by status order by val_ce, key) as rn
        from run_metrics where val_ce is not null) where rn = 1""",
    "l10_ranked": """select *, cast(row_number() over (order by test_ce asc nulls last, key) as int) as row from run_metrics""",
    "l11_top_sort": """select source as language, count(*) as count, round(avg(n_chars), 6) as perplexity from documents
        group by source order by count desc, source limit 15""",
    "l12_winner": "select * from run_metrics where test_ce is not null order by test_ce, key limit 1",
    "l13_rows": "select run as key, round(avg(loss), 6) as loss, round(avg(eval_loss), 6) as eval_loss from log_rows group by run",
    "s1_splits": " union all ".join(
        f"select '{s}' as split, count(*) as count, cast(sum(length(text)) as bigint) as chars from {t}"
        for s, t in (("train", "documents"), ("validation", "benchmark"), ("test", "conversations"))
    ),
    "s2_tagged": """select 'documents' as origin, doc_id, null as item_id, text from documents
        union all select 'benchmark', null, item_id, text from benchmark""",
    "s3_write": "select ord, language, split, code from code_split",
    "s4_write_by_language": "select language as lang_dir, split, ord, docstring from code_split",
    "s5_read_language": "select ord, split, code from code_split where language = 'fr'",
    "s6_partitions": "select distinct language as lang_dir, split from code_split",
    "s6_missing": """select * from (values ('fr', 'train'), ('fr', 'holdout'), ('python', 'train')) w(lang_dir, split)
        where not exists (select 1 from code_split c where c.language = w.lang_dir and c.split = w.split)""",
    "s7_verify": "select split, count(*) as expected, count(*) as found, true as same from code_split group by split",
    "s8_inline": """select language, count, title from (select language, count(*) as count from code_rows group by language)
        left join (values ('en', 'English'), ('fr', 'French'), ('de', 'German')) t(language, title) using (language)""",
    "s9_missing_empty": "select ord, split from code_split where split = 'holdout'",
    "s9_missing_nth": "select ord, split from code_split where split = 'test'",
    "s10_preview": """select ord, language, left(code, 100) as code, left(docstring, 100) as docstring from code_rows order by ord limit 5""",
}


SOME_NULL = "(select * replace (nullif(language, 'de') as language) from code_rows)"
# An even mix of three: what rounding down leaves goes to the first sources.
THIRDS = {"en": {"train": 34, "validation": 4, "test": 7}, "de": {"train": 33, "validation": 3, "test": 7}, "fr": {"train": 33, "validation": 3, "test": 6}}


def third(name: str) -> str:
    rows = f"(select * from code_split where language = '{name}')"
    return f"select ord, language, split, '{name}' as source from ({quota_sample(rows, THIRDS[name])})"


COMPACT_CODE = compacted("cleaned_code", G3, CODE_HASH, QUOTAS)
COMPACT_COMMITS = compacted(
    "cleaned_commit", f"{lines('old_code')} + {lines('new_code')} between 3 and 350", PAIR_HASH.format("old_code", "new_code"), QUOTAS
)
MIX_CODE = f"(select ord, split, {CODE_CHATS['mix_code']} as text from ({COMPACT_CODE}) where {G5} and language = 'en')"
MIX_COMMITS = f"""(select ord, split, {COMMIT_CHATS['mix_commit']} as text from
    (select *, null as old_contents, null as new_contents from ({COMPACT_COMMITS})) where {G6} and language = 'python')"""
HALVES = {"train": 1050, "validation": 150, "test": 300}
MIXED_PATH = f"""select *, row_number() over (partition by split order by md5('42:' || source || ':' || ord), source || ':' || ord) as shuffle_pos
    from (select *, 'code' as source from ({quota_sample(MIX_CODE, HALVES)})
          union all select *, 'commit' from ({quota_sample(MIX_COMMITS, HALVES)}))"""
QUERIES |= {
    "pipeline_mix_counts": f"select source, split, count(*) as count from ({MIXED_PATH}) group by source, split",
    "pipeline_mix_rows": f"select ord, source, split, text, shuffle_pos from ({MIXED_PATH})",
    "t5_padded_batches": QUERIES["t5_pad"],
    "d2_sample_k_null": f"""select ord, language, code from (select *, row_number() over
        (partition by language order by md5('42:' || ord), ord) as rn from {SOME_NULL}) where rn <= 50""",
    "d4_stratified_null": f"select ord, language, split from ({split_of(SOME_NULL)})",
    "d10_mix_three_sources": f"""select *, row_number() over
        (partition by split order by md5('42:' || source || ':' || ord), source || ':' || ord) as shuffle_pos
        from ({" union all ".join(third(name) for name in THIRDS)})""",
    "r8_pairs_whole": f"""select ord, left(t, 400) || case when length(t) > 400 then '...' else '' end as truth,
        left(p, 400) || case when length(p) > 400 then '...' else '' end as prediction, p = t as exact from (
        select ord, trim(split_part({DOC}, '<|im_end|>', 1), {WS}) as t, trim(split_part(code, '<|im_end|>', 1), {WS}) as p from code_rows)""",
    "l1_curves_null": " union all ".join(
        curve(m, "filled").replace("select run,", "select nullif(run, 1) as run,") for m in ("loss", "eval_loss", "learning_rate")
    ),
    "s1_order": f"""select row_number() over () - 1 as ord, 'train' as split, doc_id, null as item_id, null as conv_id, null as turn from documents
        union all select row_number() over () - 1 + {1 << 40}, 'validation', null, item_id, null, null from benchmark
        union all select row_number() over () - 1 + {2 << 40}, 'test', null, null, conv_id, turn from conversations""",
    "s5_read_shared_folder": "select ord, split, code from code_split where language = 'en'",
    "t4_batches_null": f"""select ord, language, (row_number() over (partition by language order by ord) - 1) // 2 as batch_id
        from {SOME_NULL}""",
    "l4_last_large": QUERIES["l4_last"].replace("rn <= 10", "rn <= 20000"),
    # One file a table: the row number is the row's place in it, and the second table's file is number 1.
    "s2_file_order": "select row_number() over () - 1 as ord, doc_id from documents",
    "s2_order": f"""select row_number() over () - 1 as ord, 'documents' as origin, doc_id, null as item_id from documents
        union all select row_number() over () - 1 + {1 << 40}, 'benchmark', null, item_id from benchmark""",
}


LEADING = "\\s*[^\\s]+"
QUERIES |= {
    "g_stream_clean": "select ord, language, code, docstring from cleaned_code",
    "t7_percentiles": f"""select language, split, measure, count(*) as rows, cast(quantile_disc(v, 0.5) as bigint) as p50,
        cast(quantile_disc(v, 0.9) as bigint) as p90, cast(quantile_disc(v, 0.99) as bigint) as p99,
        cast(quantile_disc(v, 0.999) as bigint) as p99_9 from (
          select language, split, 'tokens' as measure, tokens as v from ({SIZED}) union all
          select language, split, 'prompt', prompt from ({SIZED}) union all
          select language, split, 'target', tokens - prompt from ({SIZED})) group by language, split, measure""",
    "t2_mask_offsets": f"""select * from (with
      places as (select ord, split, toks, pos, token, sum(length(token)) over (partition by ord order by pos) as upto,
          instr(text, {lit(TAG)}) + {len(TAG) - 1} as tag_end from (
        select ord, split, text, toks, unnest(toks) as token, generate_subscripts(toks, 1) as pos from (
          select ord, split, text, regexp_extract_all(text, '{LEADING}') as toks from chats))),
      pieces as (select token, cast(row_number() over (order by n desc, token) + 1 as int) as id from (
        select token, count(*) as n from places where split = 'train' group by token))
      select ord, array_to_string(list(upto order by pos), ',') as token_ends,
        array_to_string(list(case when upto <= tag_end then -100 else coalesce(id, 1) end order by pos), ',') as labels
      from places left join pieces using (token) where pos <= 1536 group by ord)""",
    "r4_pass_through": f"""select ord, source, split, language, coalesce(code, message) as text from mixed_split where split = 'train'
        union all select ord, source, split, language, {MIXED_CHATS['final_mixed']} as text from (
        select *, bool_or(ok) over (partition by split) as passes from (
          select *, {G11} and split <> 'validation' as ok from mixed_split where split <> 'train')) where ok or not passes""",
}


def oracle_queries() -> dict[str, str]:
    return {name: sql(text) for name, text in QUERIES.items()}
