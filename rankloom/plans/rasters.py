"""Queries on pixels: small screens are drawn for the rows of test tables, so what must be found in them is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ready, spread
from ..config import DAYS, SEASON_PARTS, screen
from ..operators import pixels as X
from ..operators.classify import classify
from ..operators.tabs import all_tabs, tab_regions
from ..operators.words import words_of
from ..scratch import keep
from ..sources.captures import read_text, stored_text
from .boards import flat

WIDE, TALL = 224, 64
#: Screens drawn into one Arrow batch.
AT_ONCE = 64
_SEASON = ("Mutual Assistance", "Siege", "Rare Soil War", "Defeat")
_PERIODS = ("Daily", "Weekly", "Season Total Ranking")
IMAGE = "height int, width int, nChannels int, data binary"


def drawing(n: int) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, tuple[int, int, int]]]]:
    """(words with their left and top, filled strips with left, right, top and colour) of screen number ``n``."""
    words: list[tuple[str, int, int]] = []
    fills: list[tuple[int, int, int, tuple[int, int, int]]] = []

    def row(labels: tuple[str, ...], top: int, active: int | None, on: tuple, off: tuple) -> None:
        x = 8
        for i, label in enumerate(labels):
            begin = x
            for w in label.split():
                words.append((w, x, top))
                x += 30
            fills.append((begin - 5, x - 5, top, on if i == active else off))

    grey, dull, orange, white = (90, 90, 90), (120, 120, 120), (230, 120, 30), (250, 250, 250)
    kind, a = n % 3, n // 3
    if kind == 0:
        row(("STRENGTH", "RANKING"), 4, None, grey, grey)
        row(("Power", "Kills", "Donation"), 24, min(a % 4, 2), orange, grey)
        if a % 4 >= 2:
            row(("Daily", "Weekly"), 46, a % 4 - 2, white, dull)
    elif kind == 1:
        row(("ALLIANCE", "CONTRIBUTION"), 4, None, grey, grey)
        row(_SEASON, 24, a % 4, orange, grey)
        row(_PERIODS, 46, a // 4 % 3, white, dull)
    else:
        row(("Daily", "Rank"), 4, None, grey, grey)
        row(tuple(s.capitalize() + "." for s in DAYS.values()), 24, a % 6, white, dull)
    return words, fills


def _draw(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, images) of the screens with the numbers of the column image_id; images come in batches of a few MB."""
    ready(ids.sparkSession)
    ids = spread(ids, "image_id")
    fields = "image_id bigint, ord int, text string, avg_x double, avg_y double, left_x int, right_x int, top_y int, bottom_y int"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, i, t, x + 10.0, y + 2.0, x, x + 20, y, y + 4) for n in b.column(0).to_pylist() for i, (t, x, y) in enumerate(drawing(n)[0])]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in fields.split(", ")])

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            data = []
            for n in b.column(0).to_pylist():
                a = np.full((TALL, WIDE, 3), 60, np.uint8)
                for left, right, top, colour in drawing(n)[1]:
                    a[max(0, top - 5) : top + 9, max(0, left) : right] = colour
                data.append(X.as_bytes(a))
            size = lambda v: pa.array([v] * len(data), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), size(TALL), size(WIDE), size(3), pa.array(data, pa.binary())], names=["image_id", "height", "width", "nChannels", "data"])

    return ids.mapInArrow(words, fields), ids.mapInArrow(images, f"image_id bigint, {IMAGE}")


def _screens(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _draw(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("image_id")))


def classify_colour(spark: SparkSession, sf: str) -> DataFrame:
    words, images = _screens(spark, sf)
    words = keep(words, "words")
    return classify(words, all_tabs(words, images))


def find_tab_region(spark: SparkSession, sf: str) -> DataFrame:
    words, _ = _screens(spark, sf)
    return tab_regions(words, screen("alliance_contribution").tabs)


def _letterboxed(spark: SparkSession, sf: str) -> DataFrame:
    """An image for each capture, a twentieth of its size, with borders as wide as its number says."""
    ids = spark.read.parquet(f"{sf}/fixture.parquet").select("capture_id", "image_width", "image_height").filter("image_width is not null and image_height is not null")
    ready(spark)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, w, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                w, h, x, y = w // 20, h // 20, n % 7, n % 5
                a = np.zeros((h, w, 3), np.uint8)
                a[y : h - y, x : w - x] = (200, 100, 50)
                rows.append((n, h, w, 3, X.as_bytes(a)))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["image_id", "height", "width", "nChannels", "data"])

    return ids.mapInArrow(draw, f"image_id bigint, {IMAGE}")


def window_black_border(spark: SparkSession, sf: str) -> DataFrame:
    return X.windows(_letterboxed(spark, sf)).select("image_id", "window.*")


def crop_colours(spark: SparkSession, sf: str) -> DataFrame:
    """The mean colour and the share of white within a box of four pixels more than the left border."""
    images = _letterboxed(spark, sf)
    boxes = images.select("image_id", F.lit("corner").alias("box"), F.lit(0).alias("left_x"), F.lit(10).alias("top_y"), F.lit(10).alias("right_x"), F.lit(20).alias("bottom_y"), F.lit(0).alias("pad"))
    return X.box_colours(images, boxes)


def ocr_slot(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the stored annotation of each image, found by its content."""
    f = spark.read.parquet(f"{sf}/fixture.parquet")
    images = f.select("capture_id", "image_hash").filter("image_hash is not null")
    found = stored_text(images, f.select("image_hash", "source_file", "annotation"))
    return words_of(found).groupBy("image_id").agg(F.count("*").alias("words"))


def ocr_engine(spark: SparkSession, sf: str) -> DataFrame:
    """What a stand-in engine, which names the colour in the middle of an image, reads."""
    from ..sources.captures import line_annotation

    def engine():
        def read(a: np.ndarray) -> dict | None:
            r, g, b = X.average_rgb(X.part(a, a.shape[1] // 2, a.shape[0] // 2, a.shape[1] // 2 + 1, a.shape[0] // 2 + 1, 0))
            return line_annotation([([(0, 0), (4, 0), (4, 2), (0, 2)], f"{r}/{g}/{b}")])

        return read

    return words_of(read_text(_letterboxed(spark, sf), engine), key="image_id").select("image_id", "text", "right_x")


QUERIES = {
    "classify_colour": classify_colour, "find_tab_region": find_tab_region, "window_black_border": window_black_border, "crop_colours": crop_colours,
    "ocr_slot": ocr_slot, "ocr_engine": ocr_engine,
}
_DAY = "CASE c_custkey // 3 % 6 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DAYS)) + " END"
_PART = "CASE c_custkey // 3 % 4 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(SEASON_PARTS[0])) + " END"
_PERIOD = "CASE c_custkey // 12 % 3 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(SEASON_PARTS[1])) + " END"
_SIZES = "FROM (SELECT capture_id, image_width // 20 AS w, image_height // 20 AS h, capture_id % 7 AS x, capture_id % 5 AS y FROM fixture WHERE image_width IS NOT NULL AND image_height IS NOT NULL) AS t"
SQL = {
    "classify_colour": f"""
SELECT c_custkey AS image_id,
  CASE c_custkey % 3 WHEN 0 THEN CASE c_custkey // 3 % 4 WHEN 0 THEN 'power' WHEN 1 THEN 'kills' WHEN 2 THEN 'donation_daily' ELSE 'donation_weekly' END
    WHEN 1 THEN concat({_PART}, '_', {_PERIOD}) ELSE {_DAY} END AS category,
  CAST(CASE WHEN c_custkey % 3 = 2 THEN 0.95 ELSE 1.0 END AS DOUBLE) AS confidence, CASE c_custkey % 3 WHEN 0 THEN 'strength' WHEN 1 THEN 'alliance' ELSE 'day_by_colour' END AS rule
FROM customer""",
    "find_tab_region": """
WITH r(category, left_x, top_y, right_x) AS (VALUES ('mutual_assistance', 8, 24, 58), ('siege', 68, 24, 88), ('rare_soil_war', 98, 24, 178), ('defeat', 188, 24, 208),
  ('daily', 8, 46, 28), ('weekly', 38, 46, 58), ('season', 68, 46, 148))
SELECT c_custkey AS image_id, category, left_x, top_y, right_x, top_y + 4 AS bottom_y FROM customer, r WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, category, left_x, top_y, right_x, top_y + 4 FROM customer, r WHERE c_custkey % 3 = 0 AND c_custkey // 3 % 4 >= 2 AND category IN ('daily', 'weekly')
UNION ALL SELECT c_custkey, category, left_x, 4, right_x, 8 FROM customer, r WHERE c_custkey % 3 = 2 AND category = 'daily'""",
    "window_black_border": f"""
SELECT capture_id AS image_id, CASE WHEN x = 0 AND y = 0 THEN NULL ELSE CAST(x AS INTEGER) END AS "left", CASE WHEN x = 0 AND y = 0 THEN NULL ELSE CAST(y AS INTEGER) END AS top,
  CASE WHEN x = 0 AND y = 0 THEN NULL ELSE CAST(w - x AS INTEGER) END AS "right", CASE WHEN x = 0 AND y = 0 THEN NULL ELSE CAST(h - y AS INTEGER) END AS bottom {_SIZES}""",
    "crop_colours": f"""
SELECT capture_id AS image_id, 'corner' AS box, CAST(200 * (10 - x) // 10 AS INTEGER) AS r, CAST(100 * (10 - x) // 10 AS INTEGER) AS g, CAST(50 * (10 - x) // 10 AS INTEGER) AS b, CAST(0 AS DOUBLE) AS white {_SIZES}""",
    "ocr_slot": f"""
WITH {flat()}, first AS (SELECT image_hash, arg_min(capture_id, source_file) AS c FROM fixture WHERE image_hash IS NOT NULL GROUP BY image_hash),
n AS (SELECT image_id, count(*) AS words FROM w GROUP BY image_id)
SELECT f.capture_id AS image_id, n.words AS words FROM fixture AS f JOIN first ON f.image_hash = first.image_hash JOIN n ON n.image_id = first.c""",
    "ocr_engine": f"SELECT capture_id AS image_id, '200/100/50' AS text, 4 AS right_x {_SIZES}",
}
