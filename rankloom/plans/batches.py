"""Queries on whole batches of images: screens are drawn for suppliers, with words written into their pixels, so that a
stand-in engine can read them wherever cropping and stacking put them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ready, spread
from ..config import DAYS
from ..operators import pixels as X
from ..operators.layout import stitch_layout
from ..operators.stitching import cropped, game_windows
from ..sources.captures import decode_images, upright
from .inputs import FRAMES, load
from .pipeline import NOTHING, answers, process_batch
from .rasters import IMAGE, _letterboxed

TALL = 480
MARK = np.array((1, 2, 3), np.uint8)
GREY, DULL, ORANGE, WHITE = (60, 60, 60), (120, 120, 120), (230, 120, 30), (250, 250, 250)


def width_of(k: int) -> int:
    return 288 if k % 3 == 0 else 216


def screen_of_supplier(k: int) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, tuple[int, int, int]]]]:
    """(words with left and top, the left and top of filled labels with their colour)."""
    words: list[tuple[str, int, int]] = []
    fills: list[tuple[int, int, tuple[int, int, int]]] = []
    labels = {0: ("Weekly", "Rank"), 1: ("STRENGTH", "RANKING"), 2: ("Daily", "Rank"), 3: ("Hello", "World")}[k % 4]
    words += [(w, 20 + 60 * i, 20) for i, w in enumerate(labels)]
    tabs = {1: ("Power", "Kills"), 2: tuple(s.capitalize() + "." for s in DAYS.values())}.get(k % 4, ())
    for i, w in enumerate(tabs):
        active = i == k // 4 % len(tabs)
        words.append((w, 10 + 34 * i, 60))
        fills.append((10 + 34 * i, 60, (ORANGE if active else DULL) if k % 4 == 1 else (WHITE if active else DULL)))
    for i in range(3 if k % 4 < 3 else 0):
        y = 150 + 100 * i
        words += [("Iron", 40, y), (f"Wolf{k}{'abc'[i]}", 75, y), (f"{100000 - 7 * k - 1000 * i:,}", 150, y + 2)]
    return words, fills


def drawn(k: int) -> np.ndarray:
    """The screen of a supplier: words are a mark, their length, and their letters three to a pixel; every second one has black borders."""
    words, fills = screen_of_supplier(k)
    a = np.empty((TALL, width_of(k), 3), np.uint8)
    a[:] = GREY
    for left, top, colour in fills:
        a[top - 5 : top + 9, left - 5 : left + 25] = colour
    for text, left, top in words:
        letters = text.encode()
        letters += b"\0" * (-len(letters) % 3)
        a[top, left] = MARK
        a[top, left + 1] = (len(letters) // 3, 0, 0)
        a[top, left + 2 : left + 2 + len(letters) // 3] = np.frombuffer(letters, np.uint8).reshape(-1, 3)
    if k % 2:
        return a
    whole = np.zeros((TALL + 12, width_of(k) + 20, 3), np.uint8)
    whole[6:-6, 10:-10] = a
    return whole


def reader():
    """The stand-in engine: it finds the marks and gives each word a box of 20 to 4 pixels."""

    def read(a: np.ndarray) -> dict[str, Any] | None:
        words = []
        for y, x in zip(*(v.tolist() for v in np.nonzero((a == MARK).all(axis=2)))):
            text = a[y, x + 2 : x + 2 + int(a[y, x + 1, 0])].tobytes().rstrip(b"\0").decode()
            box = {"vertices": [{"x": p, "y": q} for p, q in ((x, y), (x + 20, y), (x + 20, y + 4), (x, y + 4))]}
            words.append({"symbols": [{"text": text, "bounding_box": None}], "boundingbox": box, "bounding_box": None})
        block = {"paragraphs": [{"words": words, "boundingbox": None}], "boundingbox": None}
        return {"text": "", "pages": [{"width": None, "height": None, "blocks": [block]}]} if words else None

    return read


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    """(batch_id, image_seq): a screen for each supplier; those without a category are batches of their own."""
    k = F.col("s_suppkey").cast("bigint")
    batch = F.floor(k / 20) + F.when(k % 4 == 3, 1_000_000).otherwise(0)
    return spark.read.parquet(f"{sf}/supplier.parquet").select(batch.cast("bigint").alias("batch_id"), k.alias("image_seq"))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    """(batch_id, image_seq, image) of all screens, drawn in as many tasks as there are cores for."""
    ready(spark)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n in enumerate(b.column(1).to_pylist()):
                a = drawn(n)
                size = [pa.array([v], pa.int32()) for v in (a.shape[0], a.shape[1], 3)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *size, pa.array([X.as_bytes(a)], pa.binary())], names=["batch_id", "image_seq", "height", "width", "nChannels", "data"])

    return spread(_ids(spark, sf), "image_seq").mapInArrow(draw, f"batch_id bigint, image_seq bigint, {IMAGE}")


def process_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Players of all screens: cut, stacked, read in one go, taken apart, classified by words and colours, and extracted."""
    return process_batch(_batches(spark, sf), reader, stretch=False).select("batch_id", "image_seq", "category", "player_name", "score")


def process_batches_override(spark: SparkSession, sf: str) -> DataFrame:
    players = process_batch(_batches(spark, sf), reader, override="friday", stretch=False)
    return players.groupBy("batch_id", "category").agg(F.count("*").alias("players"), F.sum("score").alias("score"))


def batch_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The answer for each batch: its categories as JSON, or a warning if no player was found."""
    players = process_batch(_batches(spark, sf), reader, stretch=False).drop("candidates")
    return answers(players, _ids(spark, sf).select("batch_id"))


def batch_crop(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the images once cut to their window."""
    return cropped(_batches(spark, sf)).select("batch_id", "image_seq", "width", "height", F.length("data").alias("bytes"))


def game_window(spark: SparkSession, sf: str) -> DataFrame:
    """The window of each drawn screen: within its black borders or else around its words."""
    images = _batches(spark, sf).withColumn("image_id", F.col("image_seq"))
    ready(spark)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, x, y, x + 20, y + 4) for n in b.column(0).to_pylist() for _, x, y in screen_of_supplier(n)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.int32()) for k in range(1, 5)]], names=["image_id", "left_x", "top_y", "right_x", "bottom_y"])

    boxes = images.select("image_id").mapInArrow(words, "image_id bigint, left_x int, top_y int, right_x int, bottom_y int")
    return game_windows(images, boxes)


def stitch_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The layout where files are so large that their bytes, not only their pixels, cut a batch."""
    frames = load(spark, sf, FRAMES, "orders").withColumn("n_bytes", (F.col("image_seq") % 7 + 1) * 700_000)
    return stitch_layout(frames).drop("n_bytes")


def pixel_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions on the pixels of one image: cutting, sampling, bounds of colours, contrast, turning, and the round trip through PNG."""
    images = _letterboxed(spark, sf)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, *image in zip(*(b.column(k).to_pylist() for k in range(5))):
                a = X.as_array(*image)
                rect = X.black_border_window(a)
                cut = a if rect is None else X.crop(a, rect)
                r, g, blue = (int(v) for v in X.sample_colour(cut, 0.5, 0.5))
                turned = upright(a, 6)
                back = X.from_png(X.png(a))
                edge = X.enhance(a)[a.shape[0] // 2, a.shape[1] // 2]
                rows.append((n, cut.shape[1], cut.shape[0], X.crop_top_bottom(a, 0.1, 0.2).shape[0], r, g, blue, X.is_orange_rgb((r, g, blue)), X.white_fraction(X.enhance(cut)), int(edge[0]), turned.shape[1], turned.shape[0], back is not None and bool((back == a).all())))
            kinds = [pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.float64(), *[pa.int32()] * 3, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_PIXELS.replace(" ", "").split(","))

    kinds = "image_id bigint, cut_width int, cut_height int, kept_height int, r int, g int, b int, orange boolean, white double, stretched int, turned_width int, turned_height int, same boolean"
    return images.mapInArrow(measure, kinds)


_PIXELS = "image_id, cut_width, cut_height, kept_height, r, g, b, orange, white, stretched, turned_width, turned_height, same"


def decode_column(spark: SparkSession, sf: str) -> DataFrame:
    """PNG files in a column of bytes, one in seven of them broken, decoded: their sizes and a hash of their pixels."""
    images = _letterboxed(spark, sf)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, *image in zip(*(b.column(k).to_pylist() for k in range(5))):
                out.append(X.png(X.as_array(*image)) if n % 7 else b"broken")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["image_id", "content"])

    d = decode_images(images.mapInArrow(files, "image_id bigint, content binary"))
    return d.select("image_id", "width", "height", F.length("data").alias("bytes"))


QUERIES = {
    "process_batch": process_batches, "process_batch_override": process_batches_override, "batch_answers": batch_answers, "batch_crop": batch_crop, "game_window": game_window,
    "stitch_bytes": stitch_bytes, "pixel_functions": pixel_functions, "decode_column": decode_column,
}
_DAY = "CASE k // 4 % 6 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DAYS)) + " END"
_SUPPLIERS = f"""
s AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier),
i AS (SELECT CAST(k // 20 + CASE WHEN k % 4 = 3 THEN 1000000 ELSE 0 END AS BIGINT) AS batch_id, k AS image_seq, CASE WHEN k % 3 = 0 THEN 288 ELSE 216 END AS w,
  CASE k % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN CASE k // 4 % 2 WHEN 0 THEN 'power' ELSE 'kills' END WHEN 2 THEN {_DAY} END AS category, k FROM s),
p AS (SELECT batch_id, image_seq, category, concat('Iron Wolf', k, substring('abc', n + 1, 1)) AS player_name, CAST(100000 - 7 * k - 1000 * n AS BIGINT) AS score, n
  FROM i, (VALUES (0), (1), (2)) AS v(n) WHERE k % 4 < 3)"""
_FRAME_BYTES = """
f AS (SELECT *, (image_seq % 7 + 1) * 700000 AS z FROM ({frames})),
g AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id, width, height ORDER BY image_seq) - 1 AS INTEGER) AS group_pos FROM f),
n AS (SELECT batch_id, width, height, count(*) AS n, list(z ORDER BY image_seq) AS zs FROM f GROUP BY ALL),
cut AS (
  SELECT batch_id, width, height, CAST(0 AS BIGINT) AS lo, n, zs FROM n
  UNION ALL
  SELECT batch_id, width, height, CASE k WHEN 0 THEN lo ELSE lo + n // 2 END, CASE k WHEN 0 THEN n // 2 ELSE n - n // 2 END, zs
  FROM cut, (VALUES (0), (1)) AS v(k) WHERE n > 1 AND ((n * height + (n - 1) * 10) * width > 75000000 OR list_sum(zs[lo + 1 : lo + n]) > 20971520)),
leaf AS (SELECT * FROM cut WHERE n = 1 OR ((n * height + (n - 1) * 10) * width <= 75000000 AND list_sum(zs[lo + 1 : lo + n]) <= 20971520))"""
_SIZES = "FROM (SELECT capture_id, image_width // 20 AS w, image_height // 20 AS h, capture_id % 7 AS x, capture_id % 5 AS y FROM fixture WHERE image_width IS NOT NULL AND image_height IS NOT NULL) AS t"
_INT = "CAST({} AS INTEGER)".format
# places of the border among all values, of which one in a hundred at either end is cut
_BLACK = "(w * h - (w - 2 * x) * (h - 2 * y))"
SQL = {
    "process_batch": f"WITH {_SUPPLIERS} SELECT batch_id, image_seq, category, player_name, score FROM p",
    "process_batch_override": f"WITH {_SUPPLIERS} SELECT batch_id, 'friday' AS category, count(*) AS players, CAST(sum(score) AS BIGINT) AS score FROM p GROUP BY batch_id",
    "batch_answers": f"""
WITH {_SUPPLIERS}, a AS (SELECT batch_id, category, CAST(to_json(list({{'player_name': player_name, 'score': score}} ORDER BY image_seq, n)) AS VARCHAR) AS entries, CAST(NULL AS VARCHAR) AS warning FROM p GROUP BY batch_id, category)
SELECT * FROM a UNION ALL SELECT DISTINCT batch_id, NULL, NULL, '{NOTHING}' FROM i WHERE batch_id NOT IN (SELECT batch_id FROM p)""",
    "batch_crop": f"WITH {_SUPPLIERS} SELECT batch_id, image_seq, {_INT('w')} AS width, {_INT(TALL)} AS height, {_INT(f'w * {TALL} * 3')} AS bytes FROM i",
    "game_window": f"""
WITH {_SUPPLIERS}, b AS (SELECT k, w, CASE WHEN k % 4 = 2 THEN 10 WHEN k % 4 = 1 THEN 10 ELSE 20 END AS l, CASE k % 4 WHEN 2 THEN 200 WHEN 3 THEN 100 ELSE 170 END AS r, CASE WHEN k % 4 = 3 THEN 24 ELSE 356 END AS bt FROM i)
SELECT k AS image_id, 10 AS "left", 6 AS top, {_INT('w + 10')} AS "right", {TALL + 6} AS bottom FROM i WHERE k % 2 = 0
UNION ALL SELECT k, {_INT('greatest(0, l - w * 2 // 100)')}, {20 - TALL * 2 // 100}, {_INT('least(w, r + w * 2 // 100)')}, {_INT(f'bt + {TALL * 2 // 100}')} FROM b WHERE k % 2 = 1 AND bt > 24""",
    "stitch_bytes": f"""
WITH RECURSIVE {_FRAME_BYTES.format(frames=FRAMES)}
SELECT g.batch_id, g.image_seq, g.width, g.height, g.group_pos, leaf.lo AS sub_batch, CAST((group_pos - leaf.lo) * (g.height + 10) AS BIGINT) AS y_start, CAST((group_pos - leaf.lo) * (g.height + 10) + g.height AS BIGINT) AS y_end
FROM g JOIN leaf ON g.batch_id = leaf.batch_id AND g.width = leaf.width AND g.height = leaf.height AND g.group_pos >= leaf.lo AND g.group_pos < leaf.lo + leaf.n""",
    "pixel_functions": f"""
SELECT capture_id AS image_id, {_INT('w - 2 * x')} AS cut_width, {_INT('h - 2 * y')} AS cut_height, {_INT('h - h // 10 - h // 5')} AS kept_height, 200 AS r, 100 AS g, 50 AS b, true AS orange, CAST(0 AS DOUBLE) AS white,
  {_INT(f'CASE WHEN round(0.01 * (w * h - 1)) < {_BLACK} THEN 255 ELSE 200 END')} AS stretched, {_INT('h')} AS turned_width, {_INT('w')} AS turned_height, true AS same {_SIZES}""",
    "decode_column": f"SELECT capture_id AS image_id, {_INT('CASE WHEN capture_id % 7 <> 0 THEN w END')} AS width, {_INT('CASE WHEN capture_id % 7 <> 0 THEN h END')} AS height, {_INT('CASE WHEN capture_id % 7 <> 0 THEN w * h * 3 END')} AS bytes {_SIZES}",
}
