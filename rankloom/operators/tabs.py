"""The active tabs of images, from words that label tabs and the colours around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import BATCH_BYTES
from ..config import ActiveIndicator, Screen, Tabs, screen
from ..functions.text import day_of_label, strip
from ..scratch import keep
from .classify import STRENGTH, brightest, is_orange
from .pixels import box_colours, packed_images
from .skew import broadcast_if_small

EDGES = ("left_x", "top_y", "right_x", "bottom_y")
#: Between the parts of a box's name.
SEP = "\x1f"
# Share of a word's height within which another is on its row, and the least of it and of the slack in pixels.
SAME_ROW, LEAST_ROW, LEAST_SLACK = 0.6, 8, 4


def _value(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.greatest(r, g, b) / F.lit(255.0)


def _padding(fraction: float, least: int) -> Column:
    return F.greatest(F.lit(least), F.bround(F.col("width") * fraction).cast("int"))


def _sized(words: DataFrame, images: DataFrame, ai: ActiveIndicator, least: int) -> DataFrame:
    return words.join(images.select("image_id", "width"), "image_id").withColumn("pad", _padding(ai.bbox_padding_fraction, least))


def _boxes(rows: DataFrame, box: str | Column, *prefix: str) -> DataFrame:
    """(image_id, box, edges, pad): the boxes whose colours are asked for, named by ``prefix`` and ``box``."""
    name = F.concat_ws(SEP, *[F.lit(x) for x in prefix], F.col(box) if isinstance(box, str) else box)
    return rows.select("image_id", name.alias("box"), *EDGES, "pad")


def _named(colours: DataFrame, *prefix: str) -> DataFrame:
    """The colours of the boxes with ``prefix``, under their own name."""
    start = SEP.join([*prefix, ""])
    return colours.filter(F.startswith("box", F.lit(start))).withColumn("box", F.substring("box", len(start) + 1, 1 << 20))


def day_boxes(words: DataFrame, images: DataFrame, s: Screen | None = None) -> DataFrame:
    ai = (s or screen("daily_ranking")).tabs.active_indicator
    boxes = words.withColumn("day", day_of_label(F.col("text"))).filter("day is not null")
    return _boxes(_sized(boxes, images, ai, 1), "day", "day")


def day_of_colours(colours: DataFrame, s: Screen | None = None) -> DataFrame:
    ai = (s or screen("daily_ranking")).tabs.active_indicator
    return brightest(_named(colours, "day").withColumn("v", _value()).withColumnRenamed("box", "day_by_colour"), "image_id", "day_by_colour", "v", ai.min_gap)


def day_by_colour(words: DataFrame, images: DataFrame, s: Screen | None = None) -> DataFrame:
    """(image_id, day_by_colour): the day whose tab is brighter than any other's by the gap of the daily screen."""
    return day_of_colours(box_colours(images, day_boxes(words, images, s)), s)


def _labels(tabs: Tabs) -> dict[str, list]:
    items: dict[str, list] = {}
    for t in tabs.items:
        if t.signals:
            items.setdefault(t.signals[0].lower(), []).append(t)
    return items


def _shared(tabs: Tabs) -> dict[str, dict[str, str]]:
    """label -> text of a sub-tab -> category, for labels that several tabs share."""
    return {label: of for label, ts in _labels(tabs).items() if len(ts) > 1 and (of := {t.signals[1].lower(): t.category for t in ts if len(t.signals) > 1})}


def active_boxes(words: DataFrame, images: DataFrame, tabs: Tabs, name: str = "") -> DataFrame:
    """The topmost word of each label, with the place at which the label first appears, and all words of its sub-tabs."""
    sized = _sized(words.withColumn("label", F.lower(strip(F.col("text")))), images, tabs.active_indicator, 4)
    edges = F.struct(*EDGES, "pad")
    top = sized.filter(F.col("label").isin(list(_labels(tabs)))).groupBy("image_id", "label").agg(F.min_by(edges, F.struct("avg_y", "ord")).alias("w"), F.min("ord").alias("seen"))
    out = _boxes(top.select("image_id", "label", "seen", "w.*"), F.concat_ws(SEP, F.col("seen").cast("string"), F.col("label")), name, "top")
    for label, of in _shared(tabs).items():
        category = F.lit(None).cast("string")
        for k, v in of.items():
            category = F.when(F.col("label") == k, F.lit(v)).otherwise(category)
        out = out.unionByName(_boxes(sized.withColumn("category", category).filter("category is not null"), "category", name, "sub", label))
    return out


def active_of_colours(colours: DataFrame, tabs: Tabs, name: str = "") -> DataFrame:
    ai, items = tabs.active_indicator, _labels(tabs)
    top = _named(colours, name, "top").filter(is_orange(F.col("r"), F.col("g"), F.col("b"), ai.hsv))
    top = top.select("image_id", F.substring_index("box", SEP, 1).cast("int").alias("seen"), F.substring_index("box", SEP, -1).alias("label"))
    winner = top.groupBy("image_id").agg(F.min_by("label", "seen").alias("label"))
    first = F.lit(None).cast("string")
    for label, of in items.items():
        first = F.when(F.col("label") == label, F.lit(of[0].category)).otherwise(first)
    winner, sub = winner.withColumn("first", first), None
    for label in _shared(tabs):
        c = _named(colours, name, "sub", label).withColumn("v", _value()).withColumnRenamed("box", "sub")
        one = brightest(c, "image_id", "sub", "v", ai.min_gap).withColumn("label", F.lit(label))
        sub = one if sub is None else sub.unionByName(one)
    if sub is None:
        return winner.select("image_id", F.col("first").alias("tab"))
    return winner.join(sub, ["image_id", "label"], "left").select("image_id", F.coalesce("sub", "first").alias("tab"))


def active_tab(words: DataFrame, images: DataFrame, tabs: Tabs) -> DataFrame:
    """(image_id, tab): the tab of the first orange label among the labels' topmost words, in the order in which labels appear.

    A label that several tabs share has sub-tabs, of which the brightest counts, or the first tab if none leads by the gap.
    """
    return active_of_colours(box_colours(images, active_boxes(words, images, tabs)), tabs)


def _strengths(screens: tuple[Screen, ...] | None) -> list[tuple[str, Tabs]]:
    return [(id_, s.tabs) for id_ in STRENGTH if (s := screen(id_, screens)) and s.tabs]


def strength_of_colours(colours: DataFrame, screens: tuple[Screen, ...] | None = None) -> DataFrame:
    found = [active_of_colours(colours, tabs, id_).withColumn("k", F.lit(k)) for k, (id_, tabs) in enumerate(_strengths(screens))]
    return reduce(DataFrame.unionByName, found).groupBy("image_id").agg(F.min_by("tab", "k").alias("strength_tab"))


def strength_boxes(words: DataFrame, images: DataFrame, screens: tuple[Screen, ...] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [active_boxes(words, images, tabs, id_) for id_, tabs in _strengths(screens)])


def strength_tab(words: DataFrame, images: DataFrame, screens: tuple[Screen, ...] | None = None) -> DataFrame:
    """(image_id, strength_tab): of the screens of strength in order, the first in which a tab is active."""
    return strength_of_colours(box_colours(images, strength_boxes(words, images, screens)), screens)


def tab_regions(words: DataFrame, tabs: Tabs) -> DataFrame:
    """(image_id, category, left_x, top_y, right_x, bottom_y): where each tab's label is.

    The first signal counts of which one word of the image contains all words. Without such, a signal's words are
    followed from left to right along one row: each next word is the leftmost that contains it, on the row of the first
    word and not left of the one before by more than a slack. Only the words that contain some word of a signal take part.
    """
    spark = words.sparkSession
    rows = [(t.category, i, s.lower().split()) for t in tabs.items for i, s in enumerate(t.signals)]
    dim = broadcast_if_small(spark.createDataFrame(rows, "category string, signal int, parts array<string>"))
    w = words.select("image_id", "ord", F.lower(strip(F.col("text"))).alias("t"), "avg_y", *EDGES)
    hit = w.join(dim, F.exists("parts", lambda p: F.contains(F.col("t"), p)))
    edges = F.struct(*EDGES)
    whole = hit.filter(F.forall("parts", lambda p: F.contains(F.col("t"), p)))
    single = whole.groupBy("image_id", "category").agg(F.min_by(edges, F.struct("signal", "ord")).alias("e"))
    # word by word along the row: at each step every chain takes the leftmost word that may follow
    rest = hit.filter(F.size("parts") > 1).join(single.select("image_id", "category"), ["image_id", "category"], "left_anti")
    chain = rest.filter(F.contains(F.col("t"), F.get("parts", F.lit(0))) & F.col("left_x").isNotNull())
    tolerance = F.greatest(F.lit(LEAST_ROW), ((F.col("bottom_y") - F.col("top_y")) * SAME_ROW).cast("int"))
    chain = chain.select(
        "image_id", "category", "signal", "parts", F.col("ord").alias("first"), F.col("avg_y").alias("y"), tolerance.alias("tol"), F.array("ord").alias("used"),
        F.col("right_x").alias("after"), *EDGES,
    ).withColumn("slack", F.greatest(F.lit(LEAST_SLACK), (F.col("tol") / 2).cast("int")))
    longest = max((len(r[2]) for r in rows), default=1)
    follow = rest.select("image_id", "category", "signal", "ord", "t", "avg_y", *[F.col(e).alias(f"n_{e}") for e in EDGES])
    done = None
    for k in range(1, longest):
        ended = chain.filter(F.size("parts") == k)
        done = ended if done is None else done.unionByName(ended)
        more = chain.filter(F.size("parts") > k).join(follow, ["image_id", "category", "signal"])
        fits = (
            F.contains(F.col("t"), F.get("parts", F.lit(k))) & ~F.array_contains("used", F.col("ord")) & (F.abs(F.col("avg_y") - F.col("y")) <= F.col("tol"))
            & (F.col("n_left_x") >= F.col("after") - F.col("slack"))
        )
        rank = F.row_number().over(Window.partitionBy("image_id", "category", "signal", "first").orderBy("n_left_x", "ord"))
        next_ = more.filter(fits).withColumn("rank", rank).filter("rank = 1")
        chain = next_.select(
            "image_id", "category", "signal", "parts", "first", "y", "tol", F.concat("used", F.array("ord")).alias("used"), F.col("n_right_x").alias("after"),
            F.least("left_x", "n_left_x").alias("left_x"), F.least("top_y", "n_top_y").alias("top_y"), F.greatest("right_x", "n_right_x").alias("right_x"), F.greatest("bottom_y", "n_bottom_y").alias("bottom_y"), "slack",
        )
    done = chain if done is None else done.unionByName(chain.filter(F.size("parts") == longest))
    along = done.groupBy("image_id", "category").agg(F.min_by(edges, F.struct("signal", "first")).alias("e"))
    return single.unionByName(along).select("image_id", "category", "e.*").filter("left_x is not null")


def alliance_boxes(words: DataFrame, images: DataFrame, s: Screen | None = None) -> DataFrame:
    tabs = (s or screen("alliance_contribution")).tabs
    return _boxes(_sized(tab_regions(words, tabs), images, tabs.active_indicator, 4), "category", "alliance")


def alliance_of_colours(all_colours: DataFrame, s: Screen | None = None) -> DataFrame:
    tabs = (s or screen("alliance_contribution")).tabs
    ai = tabs.active_indicator
    colours = _named(all_colours, "alliance").withColumnRenamed("box", "category")
    won = None
    for k, (group, g) in enumerate(tabs.groups.items()):
        names = [t.category for t in tabs.items if t.group == group]
        own = colours.filter(F.col("category").isin(names))
        if g.strategy == "brightest":
            one = brightest(own, "image_id", "category", "white", g.min_fraction)
        else:
            place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category"))
            orange = own.filter(is_orange(F.col("r"), F.col("g"), F.col("b"), ai.hsv))
            one = orange.groupBy("image_id").agg(F.min_by("category", place).alias("category"))
        one = one.select("image_id", F.lit(k).alias("k"), "category")
        won = one if won is None else won.unionByName(one)
    joined = won.groupBy("image_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "category"))), lambda x: x["category"]), "_").alias("alliance_tab"))
    return joined.filter(F.col("n") == len(tabs.groups)).drop("n")


def alliance_tab(words: DataFrame, images: DataFrame, s: Screen | None = None) -> DataFrame:
    """(image_id, alliance_tab): the active tabs of all groups joined by ``_``; images in which a group has none have no row."""
    return alliance_of_colours(box_colours(images, alliance_boxes(words, images, s)), s)


def all_tabs(words: DataFrame, images: DataFrame, screens: tuple[Screen, ...] | None = None) -> DataFrame:
    """(image_id, strength_tab, alliance_tab, day_by_colour) of all images of which some active tab is known.

    The boxes of all kinds of tabs go to the pixels together, so pixels are shuffled and read once; what comes back, a few
    numbers for each box, is kept. Pixels that aren't packed are packed and kept first, as their widths are asked for several
    times.
    """
    if "packed" not in images.columns:
        images = keep(packed_images(images, "image_id"), "images", group_bytes=BATCH_BYTES)
    alliance, daily = screen("alliance_contribution", screens), screen("daily_ranking", screens)
    boxes = strength_boxes(words, images, screens).unionByName(alliance_boxes(words, images, alliance)).unionByName(day_boxes(words, images, daily))
    colours = keep(box_colours(images, boxes), "colours")
    out = strength_of_colours(colours, screens).join(alliance_of_colours(colours, alliance), "image_id", "full")
    return out.join(day_of_colours(colours, daily), "image_id", "full")
