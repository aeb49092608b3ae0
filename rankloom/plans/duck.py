"""Pieces of SQL for the engine that results are compared with."""

from __future__ import annotations

from ..config import ALLIANCE_SUFFIXES, UI_LABELS, day_labels

WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WS = WS[1:-1]


def cut(x: str, pattern: str, to: str = "", options: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', '{options}')"


def strip(x: str) -> str:
    return cut(x, f"^{WS}+|{WS}+$")


def alliance_tag(x: str) -> str:
    return strip(cut(x, r"[\[\(][^\]\)]{1,10}[\]\)]"))


def leading_rank(x: str) -> str:
    return strip(cut(x, rf"^\p{{Nd}}{{1,3}}[.{_WS}]*", options=""))


def rank_badge(x: str) -> str:
    return strip(cut(x, r"\bR[1-5]\b"))


def noise(x: str) -> str:
    return strip(cut(x, rf"[^\p{{L}}\p{{N}}_{_WS}\-'\x{{c0}}-\x{{24f}}\x{{400}}-\x{{4ff}}]"))


def spaces(x: str) -> str:
    return strip(cut(x, f"{WS}{{2,}}", " "))


def thai(x: str) -> str:
    return strip(cut(x, r"[\x{e00}-\x{e7f}]+"))


def tag_like(x: str) -> str:
    return f"(length({x}) BETWEEN 3 AND 4 AND regexp_matches({x}, '^.+\\p{{Lu}}') AND regexp_matches({x}, '\\p{{Ll}}'))"


def bare_tags(x: str) -> str:
    kept = f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '' AND NOT {tag_like('t')})"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {strip(x)} END"


def suffixes(x: str) -> str:
    for s in ALLIANCE_SUFFIXES:
        x = cut(x, s, options="gi")
    return strip(x)


def clean(table: str, column: str, out: str, keep: str = "*") -> str:
    """Steps of common table expressions that clean a column; the last is named ``out``."""
    before = strip(f"split_part({column}, '[', 1)")
    rest = strip(cut(before, rf"^[\p{{Nd}}{_WS}.R1-5]+", options=""))
    steps = [f"{out}_0 AS (SELECT *, CASE WHEN {rest} <> '' THEN {before} ELSE {column} END AS nm FROM {table})"]
    for i, f in enumerate((alliance_tag, bare_tags, suffixes, leading_rank, rank_badge, thai, noise, spaces)):
        steps.append(f"{out}_{i + 1} AS (SELECT * REPLACE ({f('nm')} AS nm) FROM {out}_{i})")
    return ",\n".join(steps) + f",\n{out} AS (SELECT * FROM {out}_8)"


def numeric(x: str) -> str:
    return f"regexp_matches({strip(x)}, '^[\\p{{Nd}},]+$')"


def score(x: str) -> str:
    digits = strip(f"translate({x}, 'OlI, ', '011')")
    return f"CASE WHEN regexp_full_match({digits}, '[+-]?[0-9]+') THEN TRY_CAST({digits} AS BIGINT) END"


def splits(x: str) -> str:
    """A list of structs (score, place, name, score_text), least score first."""
    good = (
        f"list_filter(range(1, length({x}) + 1), lambda i: regexp_full_match(substring({x}, i), '[0-9]{{1,3}}(,[0-9]{{3}})+') "
        f"AND NOT contains(substring({x}, 1, i - 1), ','))"
    )
    made = f"list_transform({good}, lambda i: {{'score': {score(f'substring({x}, i)')}, 'place': -i, 'name': {strip(f'substring({x}, 1, i - 1)')}, 'score_text': substring({x}, i)}})"
    return f"CASE WHEN regexp_matches({x}, '\\p{{L}}') THEN list_sort({made}) ELSE [] END"


def ui_label(x: str) -> str:
    return f"lower({strip(x)}) IN ({', '.join(repr(s) for s in UI_LABELS)})"


def day(x: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({strip(x)}) = '{k}' THEN '{v}'" for k, v in day_labels().items()) + " END"


def not_noise(x: str) -> str:
    return f"{strip(x)} <> '' AND NOT (length({strip(x)}) = 1 AND NOT regexp_matches({strip(x)}, '^\\p{{N}}$')) AND NOT {ui_label(x)}"


def is_score(x: str, least: int = 1000) -> str:
    return f"(coalesce(({score(x)}) >= {least}, false) OR coalesce((({splits(x)})[1]).score >= {least}, false))"
