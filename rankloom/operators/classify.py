"""Which leaderboard an image shows: from its words, and from the colours of its tabs where pixels are known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DAYS, Hsv, Screen, screen
from ..functions.text import day_of_label, held, strip

STRENGTH = ("strength_donation", "strength_metrics")


def _all_words(signal: str, words: Column) -> Column:
    """Whether every word of a signal is a word of the image; true for a signal without words."""
    return reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in signal.lower().split()], F.lit(True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_signals(s: Screen | None, words: Column, exact_negatives: bool = False) -> Column:
    """Some page signal, and no negative one: by its words, or as one whole word of the image if ``exact_negatives``."""
    if s is None:
        return F.lit(False)
    negative = [F.array_contains(words, n.lower()) if exact_negatives else _all_words(n, words) for n in s.negative_signals]
    return _any([_all_words(p, words) for p in s.page_signals]) & ~_any(negative)


def signals(words: DataFrame, screens: tuple[Screen, ...] | None = None) -> DataFrame:
    """One row for each image: is_strength, is_alliance, is_weekly, and the day with most points by its labels.

    A short label without its full stop, as the active tab has it, counts two points, any other day label one; of days
    with as many points the first in the week counts. One pass over the words, whose sums are made before the shuffle.
    """
    text = F.lower(strip(F.col("text")))
    day = day_of_label(F.col("text"))
    points = F.when(text.isin(list(DAYS.values())), 2).when(day.isNotNull(), 1).otherwise(0)
    per_day = [F.sum(F.when(day == d, points).otherwise(0)).alias(d) for d in DAYS]
    images = words.groupBy("image_id").agg(F.collect_set(text).alias("words"), *per_day)
    w = F.col("words")
    best = F.greatest(*DAYS)
    by_text = reduce(lambda rest, d: F.when(F.col(d) == best, F.lit(d)).otherwise(rest), reversed(DAYS), F.lit(None).cast("string"))
    return images.select(
        "image_id",
        _any([has_signals(screen(s, screens), w) for s in STRENGTH]).alias("is_strength"),
        has_signals(screen("alliance_contribution", screens), w).alias("is_alliance"),
        has_signals(screen("weekly_ranking", screens), w, exact_negatives=True).alias("is_weekly"),
        F.when(best > 0, by_text).alias("day_by_text"),
    )


def classify(words: DataFrame, tabs: DataFrame | None = None, screens: tuple[Screen, ...] | None = None) -> DataFrame:
    """(image_id, category, confidence, rule) of each image that has words.

    The first rule that holds decides: strength, alliance contribution (also if its tabs can't be told), weekly, day by
    colour, day by text. ``tabs`` has strength_tab, alliance_tab and day_by_colour of images whose pixels are known.
    """
    s = signals(words, screens)
    if tabs is None:
        none = F.lit(None).cast("string")
        s = s.withColumns({"strength_tab": none, "alliance_tab": none, "day_by_colour": none})
    else:
        s = s.join(tabs.select("image_id", "strength_tab", "alliance_tab", "day_by_colour"), "image_id", "left")
    # The confidence of each rule.
    rules = [
        ("strength", F.col("is_strength"), F.coalesce("strength_tab", F.lit("power")), F.lit(1.0)),
        ("alliance", F.col("is_alliance"), F.col("alliance_tab"), F.when(F.col("alliance_tab").isNotNull(), 1.0).otherwise(0.0)),
        ("weekly", F.col("is_weekly"), F.lit("weekly"), F.lit(1.0)),
        ("day_by_colour", F.col("day_by_colour").isNotNull(), F.col("day_by_colour"), F.lit(0.95)),
        ("day_by_text", F.col("day_by_text").isNotNull(), F.col("day_by_text"), F.lit(0.75)),
    ]
    out = F.struct(F.lit(None).cast("string").alias("category"), F.lit(0.0).alias("confidence"), F.lit("none").alias("rule"))
    for name, holds, category, confidence in reversed(rules):
        out = F.when(holds, F.struct(category.cast("string").alias("category"), confidence.alias("confidence"), F.lit(name).alias("rule"))).otherwise(out)
    return held(s, c=out).select("image_id", "c.category", "c.confidence", "c.rule")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """(h, s, v), each from 0 to 1, of a colour of three bytes."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    span = (most - least).cast("double")
    turn = F.when(r == most, (g - b) / span).when(g == most, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    h = F.when(span == 0, 0.0).otherwise(F.pmod(turn / 6.0, F.lit(1.0)))
    s = F.when(most == 0, 0.0).otherwise(span / most)
    return F.struct(h.alias("h"), s.alias("s"), (most / F.lit(255.0)).alias("v"))


def is_orange(r: Column, g: Column, b: Column, bounds: Hsv = Hsv()) -> Column:
    c = hsv(r, g, b)
    return c["h"].between(bounds.h_min, bounds.h_max) & (c["s"] >= bounds.s_min) & (c["v"] >= bounds.v_min)


def brightest(candidates: DataFrame, group: str, label: str, value: str, gap: float) -> DataFrame:
    """(group, label): the label of greatest value in each group, if it leads the next by ``gap``; a lone one wins outright.

    Of several values of a label the greatest counts, of labels with as much the least name is taken as the leader.
    """
    most = candidates.groupBy(group, label).agg(F.max(value).alias("v"))
    top = most.groupBy(group).agg(F.slice(F.sort_array(F.collect_list(F.struct("v", label)), asc=False), 1, 2).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return top.filter(second.isNull() | (first["v"] - second["v"] >= gap)).select(group, first[label].alias(label))


def category_of_name(names: DataFrame, keys: DataFrame, name: str = "name") -> DataFrame:
    """(name, category): the category whose key is contained in a file's name in lower case; the longest key wins.

    ``keys`` (key, category) is a short list; of keys as long the least counts.
    """
    from .skew import broadcast_if_small

    k = broadcast_if_small(keys.select("key", "category"))
    hit = names.join(k, F.contains(F.lower(F.col(name)), F.col("key")))
    return hit.groupBy(name).agg(F.min_by("category", F.struct(-F.length("key"), "key")).alias("category"))

