"""DuckDB SQL spellings of the comparison rules, for the oracles only.

RE2 reads ``(?U)`` as "ungreedy", so the Unicode classes are written out
and the global flag ``'g'`` is passed instead."""

from __future__ import annotations

from ..functions.rules import US_STATES


def trim_ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def null_frame(g: str, p: str, rule: str) -> str:
    return (f"(CASE WHEN {g} IS NULL AND {p} IS NULL THEN true "
            f"WHEN {g} IS NULL OR {p} IS NULL THEN false ELSE ({rule}) END)")


def text_key(x: str) -> str:
    return rf"replace(regexp_replace(lower({trim_ws(x)}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), ' ', '')"


def text_rule(g: str, p: str) -> str:
    return null_frame(g, p, f"{text_key(g)} = {text_key(p)}")


def enum_key(x: str) -> str:
    return rf"regexp_replace(lower({trim_ws(x)}), '[-\s]+', '_', 'g')"


def enum_rule(g: str, p: str) -> str:
    return null_frame(g, p, f"{enum_key(g)} = {enum_key(p)}")


NUM_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(x: str, numeric: bool = False) -> str:
    if numeric:
        return f"({x})::DOUBLE"
    return f"(CASE WHEN regexp_full_match({x}, '{NUM_TEXT}') THEN TRY_CAST({trim_ws(x)} AS DOUBLE) END)"


def number_rule(g: str, p: str, g_numeric=False, p_numeric=False) -> str:
    gn, pn = to_number(g, g_numeric), to_number(p, p_numeric)
    gt = f"({g})::VARCHAR" if g_numeric else g
    pt = f"({p})::VARCHAR" if p_numeric else p
    rule = (f"CASE WHEN {gn} IS NOT NULL AND {pn} IS NOT NULL THEN "
            f"(CASE WHEN isnan({gn}) OR isnan({pn}) THEN false ELSE {gn} = {pn} END) "
            f"ELSE {gt} = {pt} END")
    return null_frame(g, p, rule)


def casefold_rule(g: str, p: str) -> str:
    return null_frame(g, p, f"lower({trim_ws(g)}) = lower({trim_ws(p)})")


def state_values() -> str:
    rows = ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(US_STATES))
    return f"(VALUES {rows}) AS us_states(idx, code, name)"


def state_key(x: str) -> str:
    s = trim_ws(x)
    return (f"(CASE WHEN {s} = '' THEN NULL ELSE coalesce("
            f"(SELECT lower(name) FROM {state_values()} WHERE code = upper({s})), lower({s})) END)")


def state_rule(g: str, p: str) -> str:
    return null_frame(g, p, f"{state_key(g)} IS NOT DISTINCT FROM {state_key(p)}")


def date_key(x: str) -> str:
    s = trim_ws(x)
    head = trim_ws(f"split_part({s}, 'T', 1)")
    collapsed = rf"regexp_replace({head}, '\s+', ' ', 'g')"
    parsed = f"try_strptime({collapsed}, ['%B %d, %Y', '%b %d, %Y', '%m/%d/%Y', '%d/%m/%Y'])"
    return (f"(CASE WHEN {s} = '' THEN NULL "
            f"WHEN length({head}) = 10 AND regexp_full_match({head}, '[0-9]{{4}}-[^-]*-[^-]*') THEN {head} "
            f"ELSE coalesce(strftime({parsed}, '%Y-%m-%d'), {head}) END)")


def birthdate_rule(g: str, p: str) -> str:
    return null_frame(g, p, f"{date_key(g)} IS NOT DISTINCT FROM {date_key(p)}")


def date_part(x: str) -> str:
    return trim_ws(f"split_part({x}, 'T', 1)")


def datetime_date_rule(g: str, p: str) -> str:
    return null_frame(g, p, f"{date_part(g)} = {date_part(p)}")


def list_vs_text_rule(lst: str, s: str) -> str:
    return null_frame(lst, s, f"CASE WHEN len({lst}) = 1 THEN lower({trim_ws(f'{lst}[1]')}) = lower({trim_ws(s)}) ELSE false END")


def list_rule(g: str, p: str) -> str:
    return null_frame(g, p, f"{g} = {p}")


def address_line_key_list(x: str) -> str:
    v = f"(CASE WHEN len({x}) = 1 THEN lower({trim_ws(f'{x}[1]')}) END)"
    return f"(CASE WHEN {v} <> '' THEN {v} END)"


def address_line_key_text(x: str) -> str:
    v = f"lower({trim_ws(x)})"
    return f"(CASE WHEN {v} <> '' THEN {v} END)"


def pct(m: str, t: str) -> str:
    return f"(CASE WHEN {t} > 0 THEN {m}::DOUBLE / {t}::DOUBLE * 100.0 ELSE 0.0 END)"
