"""Rows of a leaderboard: words around a score, and the name and score that they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RowClustering
from ..functions.text import crash_splits, held, is_numeric_token, strip
from ..scratch import keep
from .words import is_score

# Fixed value: the height of an image that isn't known.
UNKNOWN_HEIGHT = 2400


def _bands(height: Column | int, rows: RowClustering) -> tuple[Column, Column]:
    if isinstance(height, int):
        up, down = rows.bands(height)
        return F.lit(up), F.lit(down)
    a = rows.score_anchored
    cut = lambda f: F.greatest(F.lit(1), (F.lit(f) * F.coalesce(height, F.lit(UNKNOWN_HEIGHT))).cast("int"))
    return cut(a.up_band_fraction), cut(a.down_band_fraction)


def _gap(width: Column | int, rows: RowClustering) -> Column:
    if isinstance(width, int):
        return F.lit(rows.gap(width))
    own = F.greatest(F.lit(rows.min_word_gap_px), (F.lit(rows.word_gap_fraction) * width).cast("int"))
    return F.when(F.coalesce(width, F.lit(0)) == 0, F.lit(rows.gap(0))).otherwise(own)


def row_members(words: DataFrame, height: Column | int = 2400, rows: RowClustering = RowClustering()) -> DataFrame:
    """(image_id, anchor_ord, member_pos, is_score, and the word): the words of each score's row from left to right.

    A score's row has all words that are no scores and whose centre is at most one band above or another below its own,
    bounds included; a word may be in several rows. The score itself is in its row, after words of the same place.
    Each image is cut into strips as high as a band, so a score meets the words of two strips and not of its whole image.
    A null height counts as UNKNOWN_HEIGHT. The words are kept in the shared folder once, as they are read three times.
    """
    flagged = keep(held(words, is_score=is_score(F.col("text"), rows.min_score)), "words")
    up, down = _bands(height, rows)
    strip_of = lambda y: F.floor(y / (up + down))
    anchors = flagged.filter("is_score").select("image_id", F.col("ord").alias("anchor_ord"), (F.col("avg_y") - up).alias("from_y"), (F.col("avg_y") + down).alias("to_y"), F.explode(F.sequence(strip_of(F.col("avg_y") - up), strip_of(F.col("avg_y") + down))).alias("strip"))
    others = flagged.filter("not is_score").withColumn("strip", strip_of(F.col("avg_y")))
    near = others.join(anchors, ["image_id", "strip"]).filter("avg_y between from_y and to_y").select(*flagged.columns, "anchor_ord")
    own = flagged.filter("is_score").withColumn("anchor_ord", F.col("ord"))
    every = near.unionByName(own)
    pos = F.expr("row_number() over (partition by image_id, anchor_ord order by avg_x, is_score, ord)")
    return every.withColumn("member_pos", pos)


def parsed_rows(members: DataFrame, width: Column | int = 0, rows: RowClustering = RowClustering()) -> DataFrame:
    """(image_id, anchor_ord, raw_name, raw_score, splits): rows with a name left of a score.

    The score is the rightmost number of the row or, if it has none at all, the rightmost word that ends in one.
    ``splits`` are the ways to read the last such word of the row, an empty array if there is none. A ``width`` that is
    a column gives each image its own gap between words; a null width is unknown, as 0 is.
    """
    m = F.struct("member_pos", "text", "left_x", "right_x", "avg_x")
    row = members.groupBy("image_id", "anchor_ord").agg(F.array_sort(F.collect_list(m)).alias("given"), F.max(_gap(width, rows)).alias("gap"))
    left = lambda w: F.coalesce(w["left_x"].cast("double"), w["avg_x"])
    right = lambda w: F.coalesce(w["right_x"].cast("double"), w["avg_x"])
    read = F.transform("given", lambda w: F.struct(w["text"].alias("text"), left(w).alias("left"), right(w).alias("right"), is_numeric_token(w["text"]).alias("number"), crash_splits(w["text"]).alias("splits")))
    row = held(row, m=read).drop("given")
    last = lambda good: F.array_max(F.transform(F.sequence(F.lit(1), F.size("m")), lambda i: F.when(good(F.element_at("m", i)), i)))
    row = held(row, number_at=last(lambda w: w["number"]), crash_at=last(lambda w: F.size(w["splits"]) > 0))
    at = F.coalesce("number_at", "crash_at")
    row = row.filter(at.isNotNull()).withColumn("at", at).withColumn("score_word", F.element_at("m", F.col("at")))
    split = F.when(F.col("number_at").isNull(), F.get(F.col("score_word.splits"), F.lit(0)))
    row = row.withColumn("split", split)
    names = F.filter(F.slice("m", F.lit(1), F.col("at") - 1), lambda w: w["right"] <= F.col("score_word.left"))
    parts = F.transform(names, lambda w: F.struct(w["text"].alias("text"), w["left"].alias("left"), w["right"].alias("right")))
    virtual = F.struct(F.col("split.name").alias("text"), F.col("score_word.left").alias("left"), F.col("score_word.left").alias("right"))
    parts = F.when(F.col("split").isNotNull(), F.concat(parts, F.array(virtual))).otherwise(parts)
    row = row.withColumn("parts", parts)

    def add(acc: Column, w: Column) -> Column:
        # an edge at 0 counts as unknown, and an unknown gap as a wide one
        unknown = (F.coalesce(w["left"], F.lit(0.0)) == 0) | (F.coalesce(acc["right"], F.lit(0.0)) == 0)
        wide = ~acc["first"] & (unknown | (w["left"] - acc["right"] > F.col("gap")))
        return F.struct(F.concat(acc["text"], F.when(wide, F.lit(" ")).otherwise(F.lit("")), w["text"]).alias("text"), w["right"].alias("right"), F.lit(False).alias("first"))

    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("right"), F.lit(True).alias("first"))
    name = strip(F.aggregate("parts", start, add, lambda a: a["text"]))
    score = F.when(F.col("split").isNotNull(), F.col("split.score_text")).otherwise(F.col("score_word.text"))
    crash = F.when(F.col("crash_at").isNotNull(), F.element_at("m", F.col("crash_at"))["splits"])
    none = F.filter(F.col("score_word.splits"), lambda _: F.lit(False))
    return held(row, raw_name=name, raw_score=score, read_splits=F.coalesce(crash, none)).select("image_id", "anchor_ord", "raw_name", "raw_score", F.col("read_splits").alias("splits")).filter("raw_name <> ''")
