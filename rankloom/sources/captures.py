"""Captured screenshots: image folders, stored annotations, and a slot for the engine that reads text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ready
from ..config import MOST_IMAGES
from ..operators.pixels import as_array, as_bytes, from_png
from ..operators.skew import broadcast_if_small

_BOX = "struct<vertices:array<struct<x:int,y:int>>>"


def _annotation(box: str) -> str:
    word = f"struct<symbols:array<struct<text:string,bounding_box:{_BOX}>>,{box}:{_BOX},bounding_box:{_BOX}>"
    block = f"struct<paragraphs:array<struct<words:array<{word}>,{box}:{_BOX}>>,{box}:{_BOX}>"
    return f"struct<text:string,pages:array<struct<width:int,height:int,blocks:array<{block}>>>>"


ANNOTATION = _annotation("boundingbox")
_BLOCKS = f"array<struct<text:string,bbox:{_BOX},avg_x:double,avg_y:double>>"
_IMAGE = ("height", "width", "nChannels", "data")
SUFFIXES = ("png", "jpg", "jpeg", "webp")


def capture_schema(box: str = "boundingBox") -> str:
    """The schema of stored captures; files write the box field with a capital."""
    return f"source_file string, image_hash string, image_width int, image_height int, annotation {_annotation(box)}, text_blocks {_BLOCKS}"


def _lower(df: DataFrame) -> DataFrame:
    return df.withColumn("annotation", F.col("annotation").cast(ANNOTATION))


def read_captures(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Stored captures, one JSON object in each file (or in each line, if not ``multiline``); no schema is inferred."""
    return _lower(spark.read.schema(capture_schema()).json(path, multiLine=multiline))


def stream_captures(spark: SparkSession, path: str) -> DataFrame:
    return _lower(spark.readStream.schema(capture_schema()).json(path, multiLine=True))


def write_captures(captures: DataFrame, path: str, mode: str = "append") -> None:
    captures.withColumn("annotation", F.col("annotation").cast(_annotation("boundingBox"))).write.mode(mode).json(path)


def not_stored(files: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """The files that have no stored capture yet; all of them if ``force``."""
    return files if force else files.join(stored.select("source_file").distinct(), "source_file", "left_anti")


def uploads(spark: SparkSession, path: str, most: int = MOST_IMAGES) -> DataFrame:
    """The image files of one batch as (source_file, content, length), by their suffix.

    Raises ValueError if there is none or if there are more than ``most``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.filter(F.lower(F.substring_index("path", ".", -1)).isin(list(SUFFIXES)))
    n = files.select("path").limit(most + 1).count()
    if n == 0:
        raise ValueError("no images")
    if n > most:
        raise ValueError(f"more than {most} images")
    return files.select(F.substring_index("path", "/", -1).alias("source_file"), "content", "length")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, height, width, nChannels, data) of the images of a folder, turned upright as their EXIF parts say.

    Unreadable files are left out; ValueError if none remains. Only where some file is turned do pixels go through Python.
    """
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    images = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    if images.select("path").isEmpty():
        raise ValueError("no image could be opened")
    ready(spark)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([orientation(c) for c in b.column(1).to_pylist()], pa.int32())], names=["path", "turned"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.lower("path").rlike(r"\.jpe?g$"))
    turned = files.select("path", "content").mapInArrow(turns, "path string, turned int").filter("turned > 1")
    name = F.substring_index("path", "/", -1).alias("source_file")
    if turned.isEmpty():
        return images.select(name, "height", "width", "nChannels", "data")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  (the two sources write local paths differently)
    marked = images.join(broadcast_if_small(turned.select(plain(F.col("path")).alias("at"), "turned")), plain(F.col("path")) == F.col("at"), "left")
    return upright_images(marked.select(name, "height", "width", "nChannels", "data", F.coalesce("turned", F.lit(1)).alias("turned")), "source_file")


def upright_images(images: DataFrame, key: str) -> DataFrame:
    """Images with their column ``turned`` carried out and left out; the key stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *image, turned in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
                a = as_array(*image)
                if a is not None and turned > 1:
                    a = upright(a, turned)
                    image = [a.shape[0], a.shape[1], 3, as_bytes(a)]
                rows.append(image)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=[key, *_IMAGE])

    given = images.select(key, *_IMAGE, "turned")
    return given.mapInArrow(run, f"{key} {given.schema[key].dataType.simpleString()}, height int, width int, nChannels int, data binary")


def decode_images(df: DataFrame, content: str = "content", key: str = "image_id") -> DataFrame:
    """(key, height, width, nChannels, data) of PNG files in a column of bytes; null pixels where that isn't one, or is interlaced.

    JPEG files have no decoder in Python here; they are read by ``read_images``, which takes a folder.
    """
    ready(df.sparkSession)
    given = df.select(key, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, c in enumerate(b.column(1).to_pylist()):
                a = from_png(c)
                size = (None, None, None) if a is None else (a.shape[0], a.shape[1], 3)
                data = None if a is None else as_bytes(a)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *[pa.array([v], pa.int32()) for v in size], pa.array([data], pa.binary())], names=[key, *_IMAGE])

    return given.mapInArrow(run, f"{key} {given.schema[key].dataType.simpleString()}, height int, width int, nChannels int, data binary")


def orientation(content: bytes) -> int:
    """The orientation (1 to 8) that a JPEG file's EXIF part gives; 1 if it gives none."""
    if content[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and body[:6] == b"Exif\x00\x00":
            tiff = body[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)  # noqa: B023, E731
            first = number(4, 4)
            for k in range(number(first, 2)):
                entry = first + 2 + 12 * k
                if number(entry, 2) == 0x0112:
                    value = number(entry + 8, 2)
                    return value if 1 <= value <= 8 else 1
            return 1
        at += 2 + size
    return 1


def upright(pixels: np.ndarray, turned: int) -> np.ndarray:
    """An image turned as its orientation says."""
    if turned in (2, 4, 5, 7):
        pixels = pixels[:, ::-1]
    quarter = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(turned, 0)
    return np.rot90(pixels, quarter)


def annotation_type(spark: SparkSession) -> pa.DataType:
    return spark.createDataFrame([], f"a {ANNOTATION}").toArrow().schema.field(0).type


def read_text(images: DataFrame, engine: Callable[[], Callable[[np.ndarray], dict[str, Any] | None]], key: str = "image_id") -> DataFrame:
    """(image_id, annotation): what an engine reads in each image.

    ``engine`` is called once in each task, before the first image, and gives a function from pixels to an annotation.
    The annotation is null where the image can't be decoded, nothing is read, or the engine fails.
    """
    ready(images.sparkSession)
    given = images.select(key, "height", "width", "nChannels", "data")
    kind = annotation_type(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = None
        for b in batches:
            read = read or engine()
            found = []
            for row in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                a = as_array(*row)
                try:
                    found.append(read(a) or None if a is not None else None)
                except Exception:  # one image must not end the batch
                    found.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=[key, "annotation"])

    return given.mapInArrow(run, f"{key} {given.schema[key].dataType.simpleString()}, annotation {ANNOTATION}")


def lines_of(result: Any, least: float = 0.0) -> list[tuple[list[tuple[int, int]], str]]:
    """(corners, text) of each line, in either layout in which line engines give them: mappings of lists (rec_texts, rec_scores,
    and rec_polys or dt_polys), or nested lists of [corners, (text, score)]. Lines below a score of ``least`` are left out."""
    out = []
    for page in result or []:
        if hasattr(page, "get"):
            texts = page.get("rec_texts") or []
            corners = next((c for k in ("rec_polys", "dt_polys") if (c := page.get(k)) is not None), [])
            scores = page.get("rec_scores") or [1.0] * len(texts)
            lines = zip(corners, texts, scores)
        else:
            lines = ((c, t[0], t[1]) for c, t in page or [])
        out += [([(int(x), int(y)) for x, y in c], t) for c, t, score in lines if t and score >= least]
    return out


def line_annotation(lines: list[tuple[list[tuple[int, int]], str]]) -> dict[str, Any] | None:
    """An annotation from an engine that gives lines as (corners, text): each line is one word; blank ones are left out."""
    words = []
    for corners, text in lines:
        if text and text.strip():
            box = {"vertices": [{"x": int(x), "y": int(y)} for x, y in corners]}
            words.append({"symbols": [{"text": text, "bounding_box": None}], "boundingbox": box, "bounding_box": None})
    if not words:
        return None
    block = {"paragraphs": [{"words": words, "boundingbox": None}], "boundingbox": None}
    return {"text": "\n".join(t for _, t in lines if t and t.strip()), "pages": [{"width": None, "height": None, "blocks": [block]}]}


#: Engines by the name under which a configuration chooses them.
ENGINES: dict[str, Callable[[], Callable[[np.ndarray], dict[str, Any] | None]]] = {}


def engine_of(name: str) -> Callable[[], Callable[[np.ndarray], dict[str, Any] | None]]:
    """The engine registered in ENGINES under ``name``; ValueError for an unknown one."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; known are {sorted(ENGINES)}")
    return ENGINES[name]


def capture_folder(spark: SparkSession, source: str, target: str, engine: Callable[[], Callable[[np.ndarray], dict[str, Any] | None]], force: bool = False, dry_run: bool = False) -> DataFrame:
    """(source_file, state) of each image file of a folder: ``stored``, ``skipped`` as it is stored already, ``failed``, or what
    would be done in a ``dry_run``: ``skipped`` and ``new``. New captures are appended to the folder ``target``."""
    from ..operators.words import words_of
    from ..scratch import keep

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    files = files.filter(F.lower(F.substring_index("path", ".", -1)).isin(list(SUFFIXES))).select(F.substring_index("path", "/", -1).alias("source_file"), "content")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    stored = read_captures(spark, target, multiline=False).select("source_file") if there else spark.createDataFrame([], "source_file string")
    names = keep(files.select("source_file", F.sha2("content", 256).alias("image_hash")), "files")
    new = keep(not_stored(names, stored, force), "new")
    skipped = names.join(new.select("source_file"), "source_file", "left_anti").select("source_file", F.lit("skipped").alias("state"))
    if dry_run:
        return skipped.unionByName(new.select("source_file", F.lit("new").alias("state")))
    if new.isEmpty():
        return skipped
    images = read_images(spark, source).join(new.select("source_file"), "source_file", "left_semi")
    read = keep(read_text(images, engine, key="source_file").filter("annotation is not null"), "read")
    blocks = F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "text", "left_x", "top_y", "right_x", "bottom_y", "avg_x", "avg_y"))),
        lambda w: F.struct(
            w["text"].alias("text"),
            F.when(w["left_x"].isNotNull(), F.struct(F.array(*[F.struct(w[x].alias("x"), w[y].alias("y")) for x, y in (("left_x", "top_y"), ("right_x", "top_y"), ("right_x", "bottom_y"), ("left_x", "bottom_y"))]).alias("vertices"))).alias("bbox"),
            w["avg_x"].alias("avg_x"), w["avg_y"].alias("avg_y"),
        ),
    )
    words = words_of(read, key="source_file", image_id="source_file").groupBy("source_file").agg(blocks.alias("text_blocks"))
    sizes = images.select("source_file", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    whole = new.join(sizes, "source_file").join(read, "source_file").join(words, "source_file", "left")
    write_captures(whole.select("source_file", "image_hash", "image_width", "image_height", "annotation", F.col("text_blocks").cast(_BLOCKS).alias("text_blocks")), target)
    done = new.join(read.select("source_file").withColumn("ok", F.lit(True)), "source_file", "left")
    return skipped.unionByName(done.select("source_file", F.when(F.col("ok"), F.lit("stored")).otherwise("failed").alias("state")))


def stored_text(images: DataFrame, captures: DataFrame) -> DataFrame:
    """``images`` (with image_hash) joined with the stored annotation of the same content: the engine without a network."""
    first = captures.filter("image_hash is not null").groupBy("image_hash").agg(F.min_by("annotation", "source_file").alias("annotation"))
    return images.join(first, "image_hash", "left")
