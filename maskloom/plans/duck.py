"""DuckDB SQL fragments for the oracle side of each registered query.

DuckDB's regex engine has no look-around, so the three digit-boundary types
run on a copy of the text with every non-digit doubled (adjacent matches then
never share a delimiter) and take group 1.  The other five patterns run
unchanged.  Offsets are found with a moving search cursor.
"""

from __future__ import annotations

from ..functions.patterns import REGEX_REGISTRY, TOKEN_RE

_DOUBLED = r"regexp_replace({t}, '([^0-9])', '\1\1', 'g')"

_DUCK_LISTS = {
    "PHONE": (
        "list_transform(regexp_extract_all(" + _DOUBLED + r", '(?:^|[^0-9])((?:1[3-9][0-9]{{9}})|"
        r"(?:0[0-9]{{2,3}}(?:--)?[0-9]{{7,8}}))(?:[^0-9]|$)', 1), lambda x: replace(x, '--', '-'))"
    ),
    "ID": (
        "list_transform(regexp_extract_all(" + _DOUBLED + r", '(?:^|[^0-9])([0-9]{{18}}|[0-9]{{17}}(?:XX|xx))"
        r"(?:[^0-9]|$)', 1), lambda x: substr(x, 1, 18))"
    ),
    "BANK": "regexp_extract_all(" + _DOUBLED + r", '(?:^|[^0-9])([0-9]{{16}}|[0-9]{{19}})(?:[^0-9]|$)', 1)",
}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def spans(t: str, entity_type: str) -> str:
    """DuckDB list of the matches of one registry type in text expression ``t``."""
    if entity_type in _DUCK_LISTS:
        return _DUCK_LISTS[entity_type].format(t=t)
    return f"regexp_extract_all({t}, {q(REGEX_REGISTRY[entity_type])}, 0)"


def entity_list(t: str, types=None) -> str:
    """list<struct(s, ty)> in registry order (what the literal fold consumes)."""
    types = list(REGEX_REGISTRY) if types is None else list(types)
    parts = [f"list_transform({spans(t, ty)}, lambda x: {{'s': x, 'ty': {q(ty)}}})" for ty in types]
    return parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"


def starts(t: str, lst: str) -> str:
    """0-based code-point starts of the successive matches ``lst`` in ``t``."""
    find = f"(instr(substr({t}, acc.c + 1), x) + acc.c - 1)"
    return (
        f"list_reduce({lst}, lambda acc, x: {{'c': {find} + length(x), 'st': list_append(acc.st, {find})}}, "
        "{'c': 0, 'st': []::INTEGER[]}).st"
    )


def offset_entity_list(t: str, types=None) -> str:
    """list<struct(type, start, end, span)> in (registry, position) order."""
    types = list(REGEX_REGISTRY) if types is None else list(types)
    parts = []
    for ty in types:
        lst = spans(t, ty)
        parts.append(
            f"list_transform({lst}, lambda x, i: {{'type': {q(ty)}, 'start': ({starts(t, lst)})[i], "
            f"'end': ({starts(t, lst)})[i] + length(x), 'span': x}})"
        )
    return parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"


def token(ty: str, span: str, salt: str, hex_len: int = 8, nonce: int | None = None) -> str:
    key = f"{q(salt)} || '|' || {ty} || '|' || {span}" + ("" if nonce is None else f" || '#{nonce}'")
    return f"'__MASKED_' || lower({ty}) || '_' || substr(sha256({key}), 1, {hex_len}) || '__'"


def literal_fold(t: str, ents: str, salt: str) -> str:
    """Sequential literal replace of each span by its token (direct form).

    Equal to the placeholder form for regex spans: none of them can occur
    inside a token.
    """
    return (
        f"list_reduce({ents}, lambda acc, e: {{'s': replace(acc.s, e.s, {token('e.ty', 'e.s', salt)}), 'ty': ''}}, "
        f"{{'s': {t}, 'ty': ''}}).s"
    )


def token_list(t: str) -> str:
    return f"regexp_extract_all({t}, {q(TOKEN_RE)}, 0)"


def placeholder_fold(t: str, pairs: str) -> str:
    """Two-phase literal replacement for ``pairs`` = list<struct(s, r)>:
    every span → a private-use placeholder, then placeholders → replacements."""
    idx = f"list_transform({pairs}, lambda p, i: {{'s': p.s, 'r': p.r, 'ph': chr(57344) || i::VARCHAR || chr(57345)}})"
    init = "{'s': %s, 'r': '', 'ph': ''}"
    phase1 = f"list_reduce({idx}, lambda acc, p: {{'s': replace(acc.s, p.s, p.ph), 'r': '', 'ph': ''}}, {init % t}).s"
    return f"list_reduce({idx}, lambda acc, p: {{'s': replace(acc.s, p.ph, p.r), 'r': '', 'ph': ''}}, {init % phase1}).s"


def template(ty: str, templates: dict) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in templates.items() if k != "DEFAULT")
    return f"(CASE {ty} {whens} ELSE {q(templates['DEFAULT'])} END)"
