"""The text functions of ``functions.text`` as expressions of the checking SQL engine."""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import FOLD_FROM, FOLD_PAIRS, FOLD_TO


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def case_of(table: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {x} END"


def replaced(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def fold(x: str) -> str:
    out = f"translate(lower({x}), {quoted(FOLD_FROM)}, {quoted(FOLD_TO)})"
    for k, v in FOLD_PAIRS.items():
        out = f"replace({out}, {quoted(k)}, {quoted(v)})"
    return out


def words(x: str, v: str = "w") -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda {v}: {v} <> '')"


def deleet(t: str) -> str:
    letters = f"length(regexp_replace({t}, '[^a-z]', '', 'g'))"
    mixed = f"NOT regexp_full_match({t}, '[a-z]+|[0-9]+')"
    return f"CASE WHEN {mixed} AND {letters} >= 2 * (length({t}) - {letters}) THEN translate({t}, {quoted(fixed.LEET[0])}, {quoted(fixed.LEET[1])}) ELSE {t} END"


def name_tokens(x: str) -> str:
    s = replaced(replaced(x, fixed.ID_TAG, " "), fixed.MS_PREFIX, " ")
    s = f"replace(replace({s}, '&', ' and '), '+', ' and ')"
    s = replaced(replaced(s, fixed.WEBSITE, r"\1"), fixed.NOT_ALNUM, " ")
    canonical = f"list_transform({words(s, 'a')}, lambda t: {case_of(fixed.NAME_CANON, '(' + deleet('t') + ')')})"
    return words(f"array_to_string({canonical}, ' ')", "b")


def without_legal(tokens: str) -> str:
    noise = f"(country = 'france' AND list_contains({listed(fixed.FR_NAME_NOISE)}, c))"
    return f"list_filter({tokens}, lambda c: NOT list_contains({listed(fixed.LEGAL)}, c) AND NOT {noise})"


def unglue(t: str) -> str:
    spaced = replaced(replaced(t, "([0-9]+(?:st|nd|rd|th)?)([a-z]{3,})", r"\1 \2"), "([a-z]{3})([0-9])", r"\1 \2")
    return f"CASE WHEN regexp_full_match({t}, '[a-z]+|[0-9]+|[0-9]+(st|nd|rd|th)') THEN {t} ELSE {spaced} END"


def french(t: str) -> str:
    number = f"regexp_extract({t}, '^no([0-9]+)$', 1)"
    house, suffix = (f"regexp_extract({t}, '^([0-9]+)(bis|ter|b|t)$', {k})" for k in (1, 2))
    return f"CASE WHEN {number} <> '' THEN {number} WHEN {house} <> '' THEN {house} || ' ' || {case_of(fixed.FR_ADDR_CANON, suffix)} ELSE {case_of(fixed.FR_ADDR_CANON, t)} END"


def state_table() -> str:
    return "(VALUES " + ", ".join(f"({quoted(c)}, {quoted(k)}, {quoted(s)})" for c, k, s in fixed.state_rows()) + ") AS states(country, key, state)"


def char_ngrams(x: str, n: int) -> str:
    s = f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
    many = f"list_distinct(list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n})))"
    return f"list_transform([{s}], lambda s: CASE WHEN length(s) >= {n} THEN {many} WHEN s = '' THEN [] ELSE [s] END)[1]"


def shingles(x: str, k: int = 3) -> str:
    s = f"(' ' || {x} || ' ')"
    return f"CASE WHEN length({s}) >= {k} THEN list_distinct(list_transform(range(1, length({s}) - {k} + 2), lambda i: substr({s}, i, {k}))) ELSE [] END"
