"""Images of a batch cropped to their window, stacked by size and read in one go; words come back to their image."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import BATCH_BYTES, ready, spread
from ..config import SEPARATOR_PX, WindowDetection
from ..scratch import keep
from ..sources.captures import ANNOTATION, annotation_type
from .layout import assign_regions, bbox_window, stitch_layout
from .pixels import PACKED, PACKED_FIELDS, as_array, as_bytes, black_border_window, crop, enhance, packed_images, packed_row, stack, unpacked, windows
from .words import words_of

IMAGE = ("height", "width", "nChannels", "data")
STITCH = ("batch_id", "width", "height", "sub_batch")


def game_windows(images: DataFrame, words: DataFrame | None = None, c: WindowDetection = WindowDetection()) -> DataFrame:
    """(image_id, left, top, right, bottom): the window within black borders or, where there are none, the box around the words.

    Images that are their own window, and those that couldn't be decoded, have no row.
    """
    drawn = windows(images, c).filter("window is not null").select("image_id", "window.*")
    if words is None:
        return drawn
    around = bbox_window(words, images.select("image_id", "width", "height"), c.bbox_padding_fraction, c.min_window_fraction)
    return drawn.unionByName(around.join(drawn.select("image_id"), "image_id", "left_anti").select(*drawn.columns))


def cropped(images: DataFrame, c: WindowDetection = WindowDetection(), packed: bool = False) -> DataFrame:
    """``images`` (batch_id, image_seq and the fields of the image source) cut to the window within black borders.

    Images without borders stay as they are; those that can't be decoded are left out. Where ``packed``, the pixels come
    packed, with their hash.
    """
    ready(images.sparkSession)
    given = images.select(F.col("batch_id").cast("bigint"), F.col("image_seq").cast("bigint"), *IMAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a = as_array(*(b.column(k)[i].as_py() for k in range(2, 6)))
                if a is None:
                    continue
                rect = black_border_window(a, c)
                a = a if rect is None else crop(a, rect)
                row = packed_row(a) if packed else (*a.shape[:2], 3, as_bytes(a))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *(pa.array([v], t) for v, t in zip(row, PACKED.values()))], names=["batch_id", "image_seq", *(PACKED if packed else IMAGE)])

    return given.mapInArrow(run, "batch_id bigint, image_seq bigint, " + (PACKED_FIELDS if packed else "height int, width int, nChannels int, data binary"))


def read_stitched(images: DataFrame, layout: DataFrame, engine: Callable[[], Callable[[np.ndarray], dict[str, Any] | None]], stretch: bool = True) -> DataFrame:
    """(batch_id, width, height, sub_batch, annotation, error): what an engine reads in each stitched image.

    ``layout`` places each image. A stitched image has no more pixels than the layout's limit, so one task holds it. Stitched
    images of the same content are read once; which these are is found from hashes, so only their pixels are shuffled, and
    these packed. ``stretch`` raises the contrast before the engine. Where the engine fails on an image, which doesn't end the
    others, ``error`` says why; where it reads nothing, both are null. An engine that can't start, or pixels that can't be
    stacked, end the job.
    """
    spark = images.sparkSession
    ready(spark)
    kind = annotation_type(spark)
    images = packed_images(images, "batch_id", "image_seq")
    placed = images.select("batch_id", "image_seq", "width", "height", "hash").join(layout.select("batch_id", "image_seq", "sub_batch", "y_start"), ["batch_id", "image_seq"])
    each = placed.select(*STITCH, "y_start", "hash")
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y_start", "hash"))), lambda x: x["hash"]), "")
    content = each.groupBy(*STITCH).agg(F.sha2(hashes, 256).alias("content"))
    first = content.groupBy("content").agg(F.min(F.struct(*STITCH)).alias("s")).select("s.*", "content")

    def read(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("y_start").to_pylist(), range(table.num_rows)))
        pixels = [unpacked(*(table.column(c)[i].as_py() for c in ("height", "width", "nChannels", "packed"))) for _, i in rows]
        whole = stack(pixels, SEPARATOR_PX)
        whole = enhance(whole) if stretch else whole
        read_image = engine()
        try:
            found = read_image(whole) or None
            if found is not None and "pages" not in found:
                raise ValueError(f"no annotation, but {list(found)}")
            result, error = pa.array([found], kind), None
        except Exception as e:  # one image must not end the others
            result, error = pa.array([None], kind), f"{type(e).__name__}: {e}"
        return pa.table([table.column("content").slice(0, 1), result, pa.array([error], pa.string())], names=["content", "annotation", "error"])

    wanted = placed.join(first, list(STITCH)).select("batch_id", "image_seq", "content", "y_start")
    own = images.join(wanted, ["batch_id", "image_seq"]).select("content", "y_start", "height", "width", "nChannels", "packed")
    read_ = spread(own, "content").groupBy("content").applyInArrow(read, f"content string, annotation {ANNOTATION}, error string")
    return content.join(read_, "content").select(*STITCH, "annotation", "error")


def refuse_failed(read: DataFrame) -> None:
    """RuntimeError if the engine failed on a stitched image of ``read``, with how many and the first of them."""
    failed = read.filter("error is not null").select(*STITCH, "error")
    n = failed.count()
    if n:
        first = "; ".join(f"batch {r.batch_id}, {r.width} x {r.height} from {r.sub_batch}: {r.error}" for r in failed.orderBy(*STITCH).limit(5).collect())
        raise RuntimeError(f"the engine failed on {n} of {read.count()} stitched images: {first}")


def words_of_batches(images: DataFrame, engine: Callable[[], Callable[[np.ndarray], dict[str, Any] | None]], stretch: bool = True) -> tuple[DataFrame, DataFrame]:
    """(words, layout) of cropped images: words of the stitched images with the image (batch_id, image_seq) in which they lie,
    their places relative to it. Words in the bands between images are dropped.

    All stitched images are read here, once; RuntimeError if the engine fails on one, as its images would look empty.
    """
    layout = stitch_layout(images.select("batch_id", "image_seq", "width", "height"))
    read = keep(read_stitched(images, layout, engine, stretch), "read", group_bytes=BATCH_BYTES)
    refuse_failed(read)
    found = read.filter("annotation is not null")
    key = F.concat_ws("/", *STITCH)
    words = words_of(found.select(key.alias("stitch"), "annotation"), key="stitch", image_id="stitch")
    regions = layout.select(key.alias("stitch"), F.struct("batch_id", "image_seq").alias("image_id"), "y_start", "y_end")
    placed = assign_regions(words, regions, ["stitch"]).drop("stitch")
    return placed.select("image_id", *[c for c in placed.columns if c != "image_id"]), layout
