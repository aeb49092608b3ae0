"""Problem 5: deeply nested annotations as flat tables that keep parent-child links.

Every level is one projection: nested ``transform`` calls attach the ancestors' positions,
``flatten`` joins the arrays of one level, and one ``inline`` for each target table emits its rows.
Nothing is shuffled, and no level is exploded on the way to a deeper one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("pages", "blocks", "paragraphs", "words", "symbols")
ORDINALS = ("page_ord", "block_ord", "para_ord", "word_ord", "symbol_ord")


def _nodes(root: Column, level: int, row: Callable[[Column, list[Column]], Column]) -> Column:
    """An array of ``row(node, positions)`` for all nodes of a level, in document order."""

    def below(node: Column, depth: int, at: list[Column]) -> Column:
        def one(kid: Column, i: Column) -> Column:
            here = [*at, i]
            return row(kid, here) if depth == level else below(kid, depth + 1, here)

        out = F.transform(node[LEVELS[depth]], one)  # null without children, which flatten must not meet
        if depth == level:
            return out
        return F.flatten(F.filter(out, lambda x: x.isNotNull()))

    return below(root, 0, [])


def box_of(node: Column, *fields: str) -> Column:
    """The first box field that is there."""
    return F.coalesce(*[node[f] for f in fields])


def corner(vertices: Column, axis: str, least: bool) -> Column:
    """The least or greatest coordinate; vertices without it are left out, null if none has it."""
    values = F.filter(F.transform(vertices, lambda v: v[axis]), lambda x: x.isNotNull())
    return F.array_min(values) if least else F.array_max(values)


def joined_symbols(word: Column) -> Column:
    """A word's text: its non-null symbol texts in order, untrimmed; empty without symbols."""
    texts = F.filter(F.transform(word["symbols"], lambda s: s["text"]), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def level_table(df: DataFrame, level: str, annotation: str = "annotation", key: str = "capture_id") -> DataFrame:
    """The table of one level: the key, the 0-based positions down to it, and the level's own fields.

    Absent and empty arrays have no rows; a null element of an array is a row with null fields.
    Pages have width and height, words and symbols their text, and all but pages the edges of their box.
    Boxes are taken from ``bounding_box`` or else ``boundingbox``, as far as the level has them.
    """
    n = LEVELS.index(level)
    boxes = {1: ("boundingbox",), 2: ("boundingbox",), 3: ("boundingbox", "bounding_box"), 4: ("bounding_box",)}

    def row(node: Column, at: list[Column]) -> Column:
        fields = [i.alias(name) for i, name in zip(at, ORDINALS)]
        if n == 0:
            fields += [node["width"].alias("width"), node["height"].alias("height")]
        else:
            if n == 3:
                fields.append(joined_symbols(node).alias("word_text"))
            if n == 4:
                fields.append(node["text"].alias("symbol_text"))
            v = box_of(node, *[f"{b}" for b in boxes[n]])["vertices"]
            fields += [corner(v, a, m).alias(f"{s}_{a}") for a in "xy" for s, m in (("min", True), ("max", False))]
        return F.struct(*fields)

    return df.select(F.col(f"`{key}`"), F.inline(_nodes(F.col(f"`{annotation}`"), n, row)))


def node_table(df: DataFrame, annotation: str = "annotation", key: str = "capture_id") -> DataFrame:
    """One row for each page, block, paragraph and word, from one scan and one ``inline``.

    Columns: the key, page_ord, block_ord, para_ord, word_ord (-1 below the row's own level) and word_text
    (the empty string for other rows than words). A null annotation, an absent or an empty array has no rows
    of its own level; a parent without children still has its row. Rows delivered twice are kept twice.
    """

    def row(level: int) -> Callable[[Column, list[Column]], Column]:
        def make(node: Column, at: list[Column]) -> Column:
            places = [*at, *[F.lit(-1)] * (4 - len(at))]
            text = joined_symbols(node) if level == 3 else F.lit("")
            return F.struct(*[p.cast("int").alias(o) for p, o in zip(places, ORDINALS)], text.alias("word_text"))

        return make

    root = F.col(f"`{annotation}`")
    levels = F.array(*[_nodes(root, k, row(k)) for k in range(4)])
    return df.select(F.col(f"`{key}`"), F.inline(F.flatten(F.filter(levels, lambda x: x.isNotNull()))))
