"""Cleaning of names and reading of scores, as column expressions.

All of them give null for null. White space is what Unicode calls so, not only U+0020.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ALLIANCE_SUFFIXES, UI_LABELS, Constants, day_labels

# What counts as white space, and the patterns of the functions below.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WS = WS[1:-1]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def strip_alliance_tag(c: Column) -> Column:
    """Without bracketed tags of one to ten characters; brackets need not match in kind."""
    return strip(F.regexp_replace(c, r"[\[\(][^\]\)]{1,10}[\]\)]", ""))


def strip_leading_rank(c: Column) -> Column:
    """Without up to three digits in front and the full stops and spaces after them."""
    return strip(F.regexp_replace(c, rf"^\p{{Nd}}{{1,3}}[.{_WS}]*", ""))


def strip_rank_badge(c: Column) -> Column:
    """Without R1 to R5 standing alone."""
    return strip(F.regexp_replace(c, r"(?U)\bR[1-5]\b", ""))


def strip_noise(c: Column) -> Column:
    """Letters, digits, white space, ``_``, ``-`` and ``'`` only, and all of the Latin and Cyrillic blocks."""
    return strip(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{_WS}\-'\x{{c0}}-\x{{24f}}\x{{400}}-\x{{4ff}}]", ""))


def collapse_spaces(c: Column) -> Column:
    """Two and more white spaces as one space; a single one stays what it is."""
    return strip(F.regexp_replace(c, f"{WS}{{2,}}", " "))


def strip_thai(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[\x{e00}-\x{e7f}]+", ""))


def looks_like_tag(c: Column) -> Column:
    """Three or four characters, a capital after the first, and a small letter."""
    return c.rlike(r"^(?=.{3,4}$)(?=.+\p{Lu})(?=.*\p{Ll})")


def tokens(c: Column) -> Column:
    """The parts between white space, none of them empty."""
    return F.filter(F.split(c, f"{WS}+"), lambda t: t != "")


def strip_bare_tags(c: Column) -> Column:
    """Without tag-like words, unless nothing else is left."""
    kept = F.filter(tokens(c), lambda t: ~looks_like_tag(t))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), strip(c))


def strip_alliance_suffixes(c: Column) -> Column:
    """Without the known alliance names, wherever they are and in any case."""
    for s in ALLIANCE_SUFFIXES:
        c = F.regexp_replace(c, f"(?iu){re.escape(s)}", "")
    return strip(c)


def clean_player_name(c: Column) -> Column:
    """All of it in order, on what stands before the first ``[`` if that is more than a rank and a badge."""
    before = strip(F.substring_index(c, "[", 1))
    rest = F.regexp_replace(before, rf"^[\p{{Nd}}{_WS}.R1-5]+", "")
    name = F.when(strip(rest) != "", before).otherwise(c)
    for step in (strip_alliance_tag, strip_bare_tags, strip_alliance_suffixes, strip_leading_rank, strip_rank_badge, strip_thai, strip_noise, collapse_spaces):
        name = step(name)
    return name


def is_numeric_token(c: Column) -> Column:
    """Digits and commas only."""
    return strip(c).rlike(r"^[\p{Nd},]+$")


def parse_score(c: Column) -> Column:
    """A whole number, with ``O``, ``l`` and ``I`` as digits and without commas and spaces; null if it isn't one or is beyond 2^63."""
    digits = strip(F.translate(c, "OlI, ", "011"))
    return F.when(digits.rlike("^[+-]?[0-9]+$"), digits.try_cast("bigint"))


def crash_splits(c: Column) -> Column:
    """All ways to part a name and a score that were read as one word: an array of (name, score_text, score), least score first.

    The score is grouped by commas and runs to the end; the name has no comma. Words without a letter have none.
    """
    pattern = rf"^{Constants().score_suffix}\z"
    starts = F.when(c.rlike(r"\p{L}") & c.rlike(rf"{Constants().score_suffix}\z"), F.sequence(F.lit(1), F.length(c))).otherwise(F.array().cast("array<int>"))
    good = F.filter(starts, lambda i: F.substring(c, i, F.length(c)).rlike(pattern) & (F.instr(F.substring(c, F.lit(1), i - 1), ",") == 0))
    # of equal scores, the split farthest to the right comes first
    split = F.transform(
        good,
        lambda i: F.struct(
            parse_score(F.substring(c, i, F.length(c))).alias("score"), (-i).alias("place"), strip(F.substring(c, F.lit(1), i - 1)).alias("name"), F.substring(c, i, F.length(c)).alias("score_text")
        ),
    )
    return F.transform(F.array_sort(split), lambda s: F.struct(s["name"].alias("name"), s["score_text"].alias("score_text"), s["score"].alias("score")))


def crash_split(c: Column) -> Column:
    """The split of least score, null if there is none."""
    return F.get(crash_splits(c), F.lit(0))


def day_of_label(c: Column) -> Column:
    """The day that a tab's label names, else null."""
    label = F.lower(strip(c))
    out = F.lit(None).cast("string")
    by_day: dict[str, list[str]] = {}
    for k, v in day_labels().items():
        by_day.setdefault(v, []).append(k)
    for day, labels in by_day.items():
        out = F.when(label.isin(labels), F.lit(day)).otherwise(out)
    return out


def is_ui_label(c: Column) -> Column:
    return F.lower(strip(c)).isin(list(UI_LABELS))


def is_player_row(name: Column, score: Column, least: Column | int) -> Column:
    """A name that isn't blank or a label, and a score from ``least`` on."""
    return F.coalesce((strip(name) != "") & (score >= least) & ~is_ui_label(name), F.lit(False))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def held(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with more columns, each worked out once: a generator between them and their use keeps the optimizer from
    writing a long expression out again wherever it is referred to."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))))
