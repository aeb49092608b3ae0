"""Leaderboards by category, from players of classified images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES
from ..scratch import keep


def with_category(players: DataFrame, classified: DataFrame, override: str | None = None) -> DataFrame:
    """Players with the category of their image; an override, if it isn't blank, goes for all images.

    Raises ValueError for an override that is no category. Images without a known category have no players.
    """
    if override is not None and override.strip():
        if override.strip() not in CATEGORIES:
            raise ValueError(f"unknown category: {override}")
        return players.withColumn("category", F.lit(override.strip()))
    known = classified.filter(F.col("category").isin(list(CATEGORIES))).select("image_id", "category")
    return players.join(known, "image_id")


def leaderboard(players: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(category, place, player_name, score): the rows of each category in order of image and row; nothing is merged.

    Places are counted within ranges of the sorted table and then shifted, so no category has to fit one task.
    """
    order = order or ["image_id", "anchor_ord"]
    ranged = players.filter(F.col("category").isin(list(CATEGORIES))).repartitionByRange("category", *order).sortWithinPartitions("category", *order)
    at = keep(ranged.withColumn("part", F.spark_partition_id()), "ranged")  # ids of partitions hold only for one run
    counts = at.groupBy("category", "part").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by category order by part rows between unbounded preceding and 1 preceding), 0)")
    local = F.expr(f"row_number() over (partition by category, part order by {', '.join(order)})")
    return at.withColumn("local", local).join(F.broadcast(counts.select("category", "part", before.alias("before"))), ["category", "part"]).withColumn(
        "place", (F.col("before") + F.col("local") - 1).cast("bigint")
    ).drop("part", "local", "before")


def response(players: DataFrame, *by: str) -> DataFrame:
    """(category, entries): the players of each category as a JSON array in order; null candidates are left out. With ``by``,
    for each of its values.

    A category's array is one value, as the service's answer for one batch of images has it; for tables without such a
    bound use ``leaderboard``.
    """
    entry = F.struct("player_name", "score", *(["candidates"] if "candidates" in players.columns else []))
    known = players.filter(F.col("category").isin(list(CATEGORIES)))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("image_id", "anchor_ord", entry.alias("e")))), lambda r: r["e"])
    return known.groupBy(*by, "category").agg(F.to_json(rows).alias("entries"))


def totals(players: DataFrame) -> DataFrame:
    """How many players each category has, and the sum of their scores."""
    return players.groupBy("category").agg(F.count("*").alias("players"), F.sum("score").alias("score"))
