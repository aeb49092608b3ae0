"""Players of a leaderboard from its words, with repair of merged names and scores by their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RowClustering
from ..functions.text import clean_player_name, held, is_player_row, parse_score, strip
from .rows import parsed_rows, row_members
from .words import without_noise


def read_rows(words: DataFrame, height: Column | int = 2400, width: Column | int = 1080, rows: RowClustering = RowClustering()) -> DataFrame:
    """(image_id, anchor_ord, name, score, splits) of the rows that are players', before any repair."""
    parsed = parsed_rows(row_members(without_noise(words), height, rows), width, rows)
    read = held(parsed, name=clean_player_name(F.col("raw_name")), score=parse_score(F.col("raw_score")))
    return read.filter(is_player_row(F.col("name"), F.col("score"), rows.min_score)).drop("raw_name", "raw_score")


def extract_players(words: DataFrame, height: Column | int = 2400, width: Column | int = 1080, rows: RowClustering = RowClustering()) -> DataFrame:
    """(image_id, anchor_ord, player_name, score, candidates): the players of each image in order of their rows.

    Scores fall from top to bottom. Where a row holds a merged word and its score lies outside those of the rows above
    and below, as first read, the first other split that fits replaces name and score; if none fits, they stay.
    ``candidates`` are the valid splits if there are two or more, else null. A word of more than 18 digits has no score.
    """
    read = read_rows(words, height, width, rows)
    read = held(read, cleaned=F.transform("splits", lambda s: F.struct(clean_player_name(s["name"]).alias("player_name"), s["score"].alias("score"))))
    read = held(read, valid=F.filter("cleaned", lambda s: is_player_row(s["player_name"], s["score"], rows.min_score)))
    beside = read.selectExpr(
        "*",
        "lag(score) over (partition by image_id order by anchor_ord) as upper",
        "lead(score) over (partition by image_id order by anchor_ord) as lower",
    )
    fits = lambda s: F.coalesce(s <= F.col("upper"), F.lit(True)) & F.coalesce(s >= F.col("lower"), F.lit(True))
    other = F.get(F.filter("valid", lambda s: fits(s["score"])), F.lit(0))
    fixed = held(beside, other=F.when((F.size("splits") > 0) & ~fits(F.col("score")), other))
    out = fixed.select(
        "image_id", "anchor_ord", strip(F.coalesce("other.player_name", "name")).alias("player_name"), F.coalesce("other.score", "score").alias("score"),
        F.when(F.size("valid") >= 2, F.col("valid")).alias("candidates"),
    )
    return out.filter("player_name <> '' and score > 0")
