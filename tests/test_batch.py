"""Batches of image files: turning, storing, reading in one go, and what is refused."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from rankloom.operators import pixels as X
from rankloom.operators.skew import is_small
from rankloom.plans.batches import drawn, reader
from rankloom.plans.pipeline import process_batch
from rankloom.scratch import shared_dir
from rankloom.sources import captures as C

EXIF = b"Exif\x00\x00MM\x00\x2a\x00\x00\x00\x08\x00\x01\x01\x12\x00\x03\x00\x00\x00\x01\x00\x06\x00\x00\x00\x00\x00\x00"


def jpeg(spark, path, turned=False):
    """A JPEG of 40 x 20 whose left half is red, written by the JVM, with an EXIF part that says it lies on its side."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(40, 20, 1)
    for x in range(40):
        for y in range(20):
            image.setRGB(x, y, 0xFF0000 if x < 20 else 0x0000FF)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    data = path.read_bytes()
    if turned:
        path.write_bytes(data[:2] + b"\xff\xe1" + (len(EXIF) + 2).to_bytes(2, "big") + EXIF + data[2:])


def test_turned_files_come_upright(spark, tmp_path):
    jpeg(spark, tmp_path / "flat.jpg")
    jpeg(spark, tmp_path / "turned.JPG", turned=True)
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "plain.png").write_bytes(X.png(np.full((4, 6, 3), 9, np.uint8)))
    got = {r.source_file: X.as_array(r.height, r.width, r.nChannels, r.data) for r in C.read_images(spark, str(tmp_path)).collect()}
    assert {n: a.shape[:2] for n, a in got.items()} == {"flat.jpg": (20, 40), "turned.JPG": (40, 20), "plain.png": (4, 6)}
    # a quarter turn to the right brings the left half to the top
    top, bottom = got["turned.JPG"][5, 10].astype(int), got["turned.JPG"][35, 10].astype(int)
    assert top[0] > 200 > 60 > top[2] and bottom[2] > 200 > 60 > bottom[0]


def test_no_readable_image_is_an_error(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"no image")
    with pytest.raises(ValueError, match="no image"):
        C.read_images(spark, str(tmp_path))
    none = spark.createDataFrame([(1, 1, 4, 4, 3, b"short"), (1, 2, None, None, None, None)], "batch_id long, image_seq long, height int, width int, nChannels int, data binary")
    with pytest.raises(ValueError, match="no image"):
        process_batch(none, reader)


def test_captures_of_a_folder_are_stored_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in (1, 5):
        (source / f"{k}.png").write_bytes(X.png(drawn(k)))
    (source / "blank.png").write_bytes(X.png(np.full((20, 20, 3), 60, np.uint8)))
    run = lambda **k: {r.source_file: r.state for r in C.capture_folder(spark, str(source), target, reader, **k).collect()}
    assert run(dry_run=True) == {"1.png": "new", "5.png": "new", "blank.png": "new"}
    assert run() == {"1.png": "stored", "5.png": "stored", "blank.png": "failed"}
    assert run() == {"1.png": "skipped", "5.png": "skipped", "blank.png": "failed"}
    assert run(dry_run=True, force=True) == {"1.png": "new", "5.png": "new", "blank.png": "new"}
    stored = {r.source_file: r for r in C.read_captures(spark, target, multiline=False).collect()}
    assert set(stored) == {"1.png", "5.png"} and stored["1.png"].image_width == 216 and len(stored["1.png"].text_blocks) > 5


def test_both_layouts_of_line_engines():
    box = [[1, 2], [5, 2], [5, 4], [1, 4]]
    want = [([(1, 2), (5, 2), (5, 4), (1, 4)], "abc")]
    assert C.lines_of([{"rec_texts": ["abc", "low"], "rec_scores": [0.9, 0.1], "rec_polys": [box, box]}], 0.5) == want
    assert C.lines_of([[[box, ("abc", 0.9)], [box, ("low", 0.1)]]], 0.5) == want
    assert C.lines_of(None) == [] and C.lines_of([None, []]) == []
    with pytest.raises(ValueError, match="unknown engine"):
        C.engine_of("none")


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_filters_of_png(kind):
    rng = np.random.default_rng(kind)
    row, above = rng.integers(0, 256, 12, dtype=np.uint8), rng.integers(0, 256, 12, dtype=np.uint8)
    coded = row.copy()
    for i in range(12):
        left, up, corner = (int(row[i - 3]), int(above[i]), int(above[i - 3])) if i >= 3 else (0, int(above[i]), 0)
        p = left + up - corner
        nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        coded[i] = (int(row[i]) - (0, left, up, (left + up) // 2, nearest)[kind]) % 256
    assert (X._unfilter(kind, coded, above, 3) == row).all()


def test_a_broken_optional_module_leaves_the_core():
    code = "import sys; sys.modules['rankloom.llm.bpe'] = None; import __spark_entry__ as e; q = e.queries(); assert 'extract_players' in q and 'p7_ids' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1], timeout=120)


def test_no_folder_of_the_driver_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_only_tables_of_few_rows_and_bytes_are_broadcast(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) as text")
    assert is_small(df) and not is_small(df, 9) and not is_small(df, 10, 1000) and is_small(df.limit(0))
