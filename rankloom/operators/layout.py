"""Layout of images that are read in one go: stacked by size, cut into batches, and words taken back to their image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MOST_BYTES, MOST_PIXELS, SEPARATOR_PX


def sub_batches(frames: DataFrame, most_pixels: int = MOST_PIXELS, separator: int = SEPARATOR_PX, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``frames`` (batch_id, image_seq, width, height) with group_pos, the place among the frames of its batch and size, and
    sub_batch, the first place of the slice that it is stitched in.

    A group that is too large is halved, the first half being the smaller one, until each slice fits or is one image.
    All frames of a group have one size, so the slices follow from their number: each frame walks down the halves alone.
    Where frames have ``n_bytes``, the sizes of their files, a slice must also have no more than ``most_bytes`` of them;
    the sum stands for the size of the stitched file. A null size counts as 0.
    """
    w = Window.partitionBy("batch_id", "width", "height")
    placed = frames.withColumn("group_pos", F.row_number().over(w.orderBy("image_seq")) - 1).withColumn("group_n", F.count("*").over(w))
    sized = "n_bytes" in frames.columns
    if sized:
        placed = placed.withColumn("sizes", F.transform(F.array_sort(F.collect_list(F.struct("image_seq", F.coalesce("n_bytes", F.lit(0)).cast("bigint").alias("b"))).over(w)), lambda x: x["b"]))
    weight = lambda at: F.aggregate(F.slice("sizes", (at["lo"] + 1).cast("int"), at["n"].cast("int")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    pixels = lambda n: (n * F.col("height") + (n - 1) * separator).cast("bigint") * F.col("width")

    def halve(at: Column, _: Column) -> Column:
        half = F.floor(at["n"] / 2)
        light = weight(at) <= most_bytes if sized else F.lit(True)
        fits = ((pixels(at["n"]) <= most_pixels) & light) | (at["n"] <= 1)
        low = F.col("group_pos") < at["lo"] + half
        return F.when(fits, at).when(low, F.struct(at["lo"].alias("lo"), half.alias("n"))).otherwise(F.struct((at["lo"] + half).alias("lo"), (at["n"] - half).alias("n")))

    start = F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("group_n").cast("bigint").alias("n"))
    steps = F.ceil(F.log2(F.col("group_n").cast("double"))).cast("int") + 1
    slices = F.aggregate(F.sequence(F.lit(1), steps), start, halve)
    return placed.withColumn("sub_batch", slices["lo"]).drop("group_n", "sizes")


def stitch_layout(frames: DataFrame, separator: int = SEPARATOR_PX) -> DataFrame:
    """``frames`` with sub_batch, y_start and y_end: each image below the ones before it, with a separator between."""
    cut = sub_batches(frames, separator=separator)
    before = Window.partitionBy("batch_id", "width", "height", "sub_batch").orderBy("image_seq").rowsBetween(Window.unboundedPreceding, -1)
    y = F.coalesce(F.sum(F.col("height") + separator).over(before), F.lit(0)).cast("bigint")
    return cut.withColumn("y_start", y).withColumn("y_end", y + F.col("height"))


def assign_regions(words: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Words of stitched images with the image in whose part they lie: y_start <= avg_y < y_end; words between images are dropped.

    Both have ``keys``, which name the stitched image, so the range is checked only within it. ``avg_y`` and the edges
    ``top_y`` and ``bottom_y``, as far as the words have them, become relative to the image.
    """
    r = regions.select(*keys, "image_id", "y_start", "y_end")
    hit = words.join(r, keys).filter((F.col("avg_y") >= F.col("y_start")) & (F.col("avg_y") < F.col("y_end")))
    moved = {c: (F.col(c) - F.col("y_start")).cast(words.schema[c].dataType) for c in ("avg_y", "top_y", "bottom_y") if c in words.columns}
    return hit.withColumns(moved).drop("y_start", "y_end")


def bbox_window(words: DataFrame, images: DataFrame, padding: float = 0.02, least: float = 0.20) -> DataFrame:
    """(image_id, left, top, right, bottom): the padded box around all words of an image.

    Images without boxes, with a box that is too small in either direction, or one that is the whole image have no row.
    ``images`` has image_id, width and height.
    """
    box = words.groupBy("image_id").agg(F.min("left_x").alias("l"), F.min("top_y").alias("t"), F.max("right_x").alias("r"), F.max("bottom_y").alias("b"))
    part = lambda c, f: (F.col(c) * f).cast("int")
    x = box.join(images.select("image_id", "width", "height"), "image_id").filter("l is not null and t is not null")
    x = x.select(
        "image_id", "width", "height",
        F.greatest(F.lit(0), F.col("l") - part("width", padding)).alias("left"), F.greatest(F.lit(0), F.col("t") - part("height", padding)).alias("top"),
        F.least("width", F.col("r") + part("width", padding)).alias("right"), F.least("height", F.col("b") + part("height", padding)).alias("bottom"),
    )
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    enough = (w >= part("width", least)) & (h >= part("height", least)) & ~((w == F.col("width")) & (h == F.col("height")))
    return x.filter(enough).drop("width", "height")
