"""The stemmer's rules as DuckDB SQL, by patterns: what the lexical queries are held against."""

from __future__ import annotations

from .functions import stem

V, C = "[aeiouy]", "[^aeiouy]"


def _region(p: str, times: int) -> str:
    """Whether a suffix after p lies in the first (times 1) or second region."""
    begins = "|".join(stem.BEGIN)
    special = f"regexp_matches({p}, '^({begins})" + (f".*{V}{C}')" if times == 2 else "')")
    return f"CASE WHEN regexp_matches(w, '^({begins})') THEN {special} ELSE regexp_matches({p}, '{'.*'.join([V + C] * times)}') END"


def _off(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _rules(rules: list[tuple[str, str]], times: int, also: str = "") -> str:
    """The longest suffix decides; where it isn't in its region the word stays."""
    whens = [f"WHEN suffix(w, '{end}') THEN CASE WHEN {_region(_off(len(end)), times)} THEN {_off(len(end))} || '{new}' ELSE w END" for end, new in sorted(rules, key=lambda r: -len(r[0]))]
    return "CASE " + " ".join(whens) + f" {also} ELSE w END"


SHORT = f"(regexp_matches(w, '{C}{V}[^aeiouywxY]$') OR regexp_matches(w, '^{V}{C}$'))"
_MARK = f"regexp_replace(regexp_replace(w, '^y', 'Y'), '({V})y', '\\1Y', 'g')"
_STEP_1A = f"CASE WHEN suffix(w, 'sses') THEN {_off(2)} WHEN suffix(w, 'ied') OR suffix(w, 'ies') THEN CASE WHEN length(w) > 4 THEN {_off(2)} ELSE {_off(1)} END WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '{V}.*.s$') THEN {_off(1)} ELSE w END"
_STEP_1B = "CASE " + " ".join(
    [f"WHEN suffix(w, '{x}') THEN CASE WHEN {_region(_off(len(x)), 1)} THEN {_off(len(x))} || 'ee' ELSE w END" for x in ("eedly", "eed")]
    + [f"WHEN suffix(w, '{x}') THEN CASE WHEN regexp_matches({_off(len(x))}, '{V}') THEN '!' || {_off(len(x))} ELSE w END" for x in ("ingly", "edly", "ing", "ed")]
) + " ELSE w END"
_MENDED = f"CASE WHEN x NOT LIKE '!%' THEN x WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {_off(1)} WHEN {SHORT} AND NOT ({_region('left(w, length(w) - 1)', 1)}) THEN w || 'e' ELSE w END"
_STEP_1C = f"CASE WHEN regexp_matches(w, '.{C}[yY]$') THEN {_off(1)} || 'i' ELSE w END"
_STEP_2 = _rules(stem.STEP_2, 1, f"WHEN suffix(w, 'ogi') THEN CASE WHEN suffix(w, 'logi') AND {_region(_off(3), 1)} THEN {_off(1)} ELSE w END WHEN regexp_matches(w, '[cdeghkmnrt]li$') AND {_region(_off(2), 1)} THEN {_off(2)}")
_STEP_3 = _rules(stem.STEP_3, 1, f"WHEN suffix(w, 'ative') AND {_region(_off(5), 2)} THEN {_off(5)}")
_STEP_4 = _rules([(x, "") for x in stem.STEP_4], 2, f"WHEN regexp_matches(w, '[st]ion$') AND {_region(_off(3), 2)} THEN {_off(3)}")
_STEP_5 = f"CASE WHEN suffix(w, 'e') THEN CASE WHEN {_region(_off(1), 2)} OR {_region(_off(1), 1)} AND NOT ({SHORT.replace('(w,', '(left(w, length(w) - 1),')}) THEN {_off(1)} ELSE w END WHEN suffix(w, 'll') AND {_region(_off(1), 2)} THEN {_off(1)} ELSE w END"


def stems(tokens: str) -> str:
    """(token, stem) for the distinct tokens of a query with a column token."""
    out = f"SELECT token, {_MARK} AS w FROM (SELECT DISTINCT token, token AS w FROM ({tokens}) a) b"
    out = f"SELECT token, {_STEP_1A} AS w FROM ({out}) c"
    stay = f"w IN ({', '.join(repr(x) for x in sorted(stem.STAY))})"
    out = f"SELECT token, {stay} AS stays, w FROM ({out}) d"
    out = f"SELECT token, stays, x, ltrim(x, '!') AS w FROM (SELECT token, stays, w, CASE WHEN stays THEN w ELSE {_STEP_1B} END AS x FROM ({out}) e) f"
    for step in (_MENDED, _STEP_1C, _STEP_2, _STEP_3, _STEP_4, _STEP_5):
        out = f"SELECT token, stays, {'NULL AS x, ' if step is _MENDED else ''}CASE WHEN stays THEN w ELSE {step} END AS w FROM ({out}) g"
    own = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stem.OWN.items())
    return f"SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE CASE token {own} ELSE replace(w, 'Y', 'y') END END AS stem FROM ({out}) h"
