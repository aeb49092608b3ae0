"""Pixels of many images: packed before they are kept and shuffled, in groups of few bytes, drawn and read in many tasks."""

import glob

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from rankloom import scratch
from rankloom.operators import pixels as X
from rankloom.operators import tabs
from rankloom.plans import batches, pipeline, rasters

FIELDS = "height int, width int, nChannels int, data binary"


def most_bytes(folder, column):
    """The most bytes of a column's values in one row group of a kept table."""
    files = [pq.ParquetFile(f) for f in glob.glob(f"{folder}/*.parquet")]
    return max(pc.sum(pc.binary_length(f.read_row_group(g, [column]).column(0))).as_py() or 0 for f in files for g in range(f.num_row_groups))


def test_groups_of_large_values_are_small(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, data binary").coalesce(1)
    kept = scratch.keep(df, "groups", group_bytes=1 << 20)
    assert most_bytes(scratch._written[spark.sparkContext.applicationId][-1][7:], "data") <= 2 << 20
    assert {r.id: bytes(r.data) for r in kept.collect()} == dict(rows)


def test_packed_pixels_come_back(spark):
    a = np.random.default_rng(2).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    grey = np.arange(12, dtype=np.uint8)
    rows = [(1, 7, 5, 3, X.as_bytes(a)), (2, 3, 4, 1, grey.tobytes()), (3, 9, 9, 3, b"short"), (4, None, None, None, None), (5, 5, 7, 3, X.as_bytes(a))]
    got = {r.image_id: r for r in X.packed_images(spark.createDataFrame(rows, f"image_id long, {FIELDS}"), "image_id").collect()}
    back = {k: X.unpacked(r.height, r.width, r.nChannels, r.packed) for k, r in got.items()}
    assert (back[1] == a).all() and (back[2] == grey.reshape(3, 4, 1)).all() and back[3] is None and back[4] is None
    assert got[1].hash != got[5].hash  # the same bytes in another shape are another image


@pytest.mark.parametrize("override", [None, "friday"])
def test_a_batch_keeps_few_bytes_at_once(spark, monkeypatch, override):
    """60 screens in one partition: 19 MB of pixels, which a reader took at once."""
    folders = []
    monkeypatch.setattr(pipeline, "keep", lambda df, name, **k: (kept := scratch.keep(df, name, **k), folders.append(scratch._written[spark.sparkContext.applicationId][-1][7:]))[0])
    rows = [(0, k, *a.shape, X.as_bytes(a)) for k in range(60) for a in [batches.drawn(k)]]
    players = pipeline.process_batch(spark.createDataFrame(rows, f"batch_id long, image_seq long, {FIELDS}").coalesce(1), batches.reader, override=override, stretch=False)
    assert players.count() == 45 * 3
    column = next(c for c in ("packed", "data") if c in pq.ParquetFile(glob.glob(f"{folders[0]}/*.parquet")[0]).schema_arrow.names)
    assert most_bytes(folders[0], column) <= 16 << 20


def test_answers_draw_no_image_again(spark, sf):
    plan = batches.batch_answers(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_drawn_screens_are_packed_and_kept_once_in_many_tasks(spark, monkeypatch):
    names = []
    monkeypatch.setattr(tabs, "keep", lambda df, name, **k: (names.append((name, df.rdd.getNumPartitions())), scratch.keep(df, name, **k))[1])
    words, images = rasters._draw(spark.range(60).withColumnRenamed("id", "image_id").coalesce(1))
    tabs.all_tabs(words, images)
    assert [n for n, _ in names] == ["images", "colours"] and names[0][1] > 4
