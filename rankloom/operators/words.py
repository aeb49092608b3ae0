"""Words: the flat form of an annotation, and filters on it.

A table of words has image_id, ord (0-based reading order within the image), text, avg_x, avg_y, and the edges
left_x, right_x, top_y, bottom_y, which are null where a word has no box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import crash_split, is_ui_label, parse_score, strip
from .nested import _nodes, box_of, joined_symbols

WORD = "ord int, text string, avg_x double, avg_y double, left_x int, right_x int, top_y int, bottom_y int"


def coordinates(vertices: Column, axis: str) -> Column:
    """A coordinate of each vertex, 0 where it is missing; null without vertices."""
    return F.when(F.size(vertices) > 0, F.transform(vertices, lambda v: F.coalesce(v[axis], F.lit(0))))


def centre(vertices: Column, axis: str) -> Column:
    """The mean of a coordinate, 0.0 without vertices."""
    at = coordinates(vertices, axis)
    mean = F.aggregate(at, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size(at)
    return F.coalesce(mean.cast("double"), F.lit(0.0))


def word_row(text: Column, vertices: Column, *more: Column) -> Column:
    x, y = coordinates(vertices, "x"), coordinates(vertices, "y")
    return F.struct(
        centre(vertices, "y").alias("avg_y"), centre(vertices, "x").alias("avg_x"), *more, text.alias("text"),
        F.array_min(x).alias("left_x"), F.array_max(x).alias("right_x"), F.array_min(y).alias("top_y"), F.array_max(y).alias("bottom_y"),
    )


def words_of(df: DataFrame, annotation: str = "annotation", key: str = "capture_id", image_id: str = "image_id") -> DataFrame:
    """The words of each annotation from top to bottom and left to right, blank ones left out.

    The array of words is built and sorted within the row, so nothing is shuffled. Words of equal centre keep the
    document's order. A null annotation has no words.
    """

    def row(node: Column, at: list[Column]) -> Column:
        box = box_of(node, "boundingbox", "bounding_box")["vertices"]
        return word_row(strip(joined_symbols(node)), box, F.struct(*at).alias("place"))

    words = F.array_sort(F.filter(_nodes(F.col(f"`{annotation}`"), 3, row), lambda w: w["text"] != ""))
    out = df.select(F.col(f"`{key}`").alias(image_id), F.posexplode(words).alias("ord", "w"))
    return out.select(image_id, "ord", "w.text", "w.avg_x", "w.avg_y", "w.left_x", "w.right_x", "w.top_y", "w.bottom_y")


def blocks_of(df: DataFrame, blocks: str = "text_blocks", key: str = "capture_id", image_id: str = "image_id") -> DataFrame:
    """The same table from stored text blocks, in their given order."""
    w = F.col("b")
    v = w["bbox"]["vertices"]
    out = df.select(F.col(f"`{key}`").alias(image_id), F.posexplode(F.col(f"`{blocks}`")).alias("ord", "b"))
    x, y = coordinates(v, "x"), coordinates(v, "y")
    return out.filter("b is not null").select(
        image_id, "ord", w["text"].alias("text"), F.coalesce(w["avg_x"], F.lit(0.0)).alias("avg_x"), F.coalesce(w["avg_y"], F.lit(0.0)).alias("avg_y"),
        F.array_min(x).alias("left_x"), F.array_max(x).alias("right_x"), F.array_min(y).alias("top_y"), F.array_max(y).alias("bottom_y"),
    )


def box_of_text(text: Column) -> Column:
    """Edges from the printed form of a box (``vertices { x: 4 y: 5 } ...``): a struct, null if no coordinate is there."""
    at = lambda a: F.transform(F.regexp_extract_all(text, F.lit(rf"\b{a}:\s*(-?\d+)"), F.lit(1)), lambda v: v.cast("int"))
    x, y = at("x"), at("y")
    edges = F.struct(F.array_min(x).alias("left_x"), F.array_min(y).alias("top_y"), F.array_max(x).alias("right_x"), F.array_max(y).alias("bottom_y"))
    return F.when(text.contains("vertices") & (F.size(x) > 0) & (F.size(y) > 0), edges)


def without_noise(words: DataFrame) -> DataFrame:
    """Words that may belong to a player's row: not blank, not a single character other than a digit, not a label."""
    t = strip(F.col("text"))
    single = (F.length(t) == 1) & ~t.rlike(r"^\p{N}$")
    return words.filter((t != "") & ~single & ~is_ui_label(F.col("text")))


def is_score(text: Column, least: Column | int) -> Column:
    """A number from ``least`` on, alone or at the end of a word that also holds a name."""
    alone = F.coalesce(parse_score(text) >= least, F.lit(False))
    return alone | F.coalesce(crash_split(text)["score"] >= least, F.lit(False))
