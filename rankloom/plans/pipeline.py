"""From captures to leaderboards in one plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import BATCH_BYTES
from ..config import RowClustering, default_screens
from ..operators.boards import response, with_category
from ..operators.classify import classify
from ..operators.pixels import PACKED
from ..operators.players import extract_players
from ..operators.stitching import cropped, words_of_batches
from ..operators.tabs import all_tabs
from ..operators.words import words_of
from ..scratch import keep

NOTHING = "no players were found in the images"


def process_batch(images: DataFrame, engine: Callable[[], Callable[[np.ndarray], dict[str, Any] | None]], override: str | None = None, stretch: bool = True) -> DataFrame:
    """(batch_id, image_seq, anchor_ord, player_name, score, candidates, category) of batches of images.

    ``images`` has batch_id, image_seq and the fields of the image source. Each image is cut to its window, images of a size
    are stacked and read by the engine in one go, words go back to their image, and images are classified by words and
    colours. Images that can't be decoded, have no words or no category are left out; ValueError if none can be decoded,
    RuntimeError if the engine fails on a stitched image.
    """
    cut = keep(cropped(images, packed=True), "cropped", group_bytes=BATCH_BYTES)
    if cut.isEmpty():
        raise ValueError("no image could be opened")
    words, _ = words_of_batches(cut, engine, stretch)
    words = keep(words, "words")
    named = cut.select(F.struct("batch_id", "image_seq").alias("image_id"), *PACKED)
    players = players_of(words, named.select("image_id", "width", "height"), named, override)
    return players.select("image_id.*", *[c for c in players.columns if c != "image_id"])


def answers(players: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, category, entries, warning): for each batch its categories with their players as JSON, or a warning if it has none."""
    own = players.withColumns({"image_id": F.col("image_seq")}).withColumn("batch", F.col("batch_id"))
    found = response(own, "batch").withColumnRenamed("batch", "batch_id").withColumn("warning", F.lit(None).cast("string"))
    none = batches.select("batch_id").distinct().join(found.select("batch_id"), "batch_id", "left_anti")
    none = none.select("batch_id", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("entries"), F.lit(NOTHING).alias("warning"))
    return found.unionByName(none)


def process(captures: DataFrame, images: DataFrame | None = None, override: str | None = None, key: str = "capture_id") -> DataFrame:
    """(image_id, anchor_ord, player_name, score, candidates, category) of all captures.

    ``captures`` has the key, image_width, image_height and annotation; ``images`` the pixels by image_id where known.
    Without pixels, categories come from the words alone. An override goes for all captures.
    """
    words = words_of(captures, key=key)
    sizes = captures.select(F.col(key).alias("image_id"), F.col("image_height").alias("height"), F.col("image_width").alias("width"))
    return players_of(words, sizes, images, override)


def players_of(words: DataFrame, sizes: DataFrame, images: DataFrame | None = None, override: str | None = None) -> DataFrame:
    """The same from words; ``sizes`` has image_id, width and height."""
    classified = None
    if override is None or not override.strip():
        tabs = all_tabs(words, images) if images is not None else None
        classified = classify(words, tabs)
    sized = words.join(sizes, "image_id")
    # screens differ in how rows are read only if their settings do
    kinds: dict[RowClustering, list[str]] = {}
    for s in default_screens():
        if s.tabs:
            kinds.setdefault(s.row_clustering, []).extend(t.category for t in s.tabs.items)
    if len(kinds) <= 1 or classified is None:
        return with_category(extract_players(sized, F.col("height"), F.col("width"), next(iter(kinds), RowClustering())), classified, override)
    out = None
    listed = [c for cs in kinds.values() for c in cs]
    for rows, categories in [*kinds.items(), (RowClustering(), None)]:
        own = classified.filter(F.col("category").isin(categories) if categories else ~F.col("category").isin(listed))
        one = with_category(extract_players(sized.join(own.select("image_id"), "image_id", "left_semi"), F.col("height"), F.col("width"), rows), own, None)
        out = one if out is None else out.unionByName(one)
    return out
