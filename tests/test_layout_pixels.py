import numpy as np
import pytest

from rankloom.operators import pixels as X
from rankloom.operators.layout import assign_regions, stitch_layout
from rankloom.sources.captures import orientation, upright


def test_a_hundred_frames_are_cut_into_four(spark):
    frames = spark.range(100).selectExpr("1 as batch_id", "cast(id as int) as image_seq", "1080 as width", "2400 as height")
    got = stitch_layout(frames)
    assert sorted({r.sub_batch for r in got.collect()}) == [0, 25, 50, 75]
    first = got.filter("sub_batch = 25").orderBy("image_seq").limit(2).collect()
    assert [(r.y_start, r.y_end) for r in first] == [(0, 2400), (2410, 4810)]


def test_words_between_images_belong_to_none(spark):
    r = spark.createDataFrame([(1, 10, 0, 100), (1, 11, 110, 210)], "k int, image_id int, y_start int, y_end int")
    w = spark.createDataFrame([(1, 0, 0.0), (1, 1, 99.9), (1, 2, 100.0), (1, 3, 110.0), (2, 4, 5.0)], "k int, ord int, avg_y double")
    assert sorted((x.ord, x.image_id, x.avg_y) for x in assign_regions(w, r, ["k"]).collect()) == [(0, 10, 0.0), (1, 10, 99.9), (3, 11, 0.0)]


def test_letterbox_window():
    a = np.zeros((1840, 2208, 3), np.uint8)
    a[:, 559:1650] = (200, 100, 50)
    assert X.black_border_window(a) == (559, 0, 1650, 1840)
    assert X.black_border_window(np.full((50, 50, 3), 90, np.uint8)) is None
    assert X.black_border_window(np.zeros((50, 50, 3), np.uint8)) is None


def test_crop_and_colours():
    a = np.zeros((10, 10, 3), np.uint8)
    a[:, 5:] = (255, 255, 255)
    assert X.average_rgb(a) == (127, 127, 127) and X.white_fraction(a) == 0.5
    assert X.average_rgb(a[:0]) == (0, 0, 0) and X.white_fraction(a[:0]) == 0.0
    assert X.crop(a, (5, 0, 10, 10)).min() == 255
    with pytest.raises(ValueError):
        X.crop(a, (0, 0, 11, 10))
    assert X.is_orange_rgb((230, 120, 30)) and not X.is_orange_rgb((90, 90, 90))
    assert X.enhance(np.tile(np.arange(50, 150, dtype=np.uint8)[:, None, None], (1, 4, 3))).max() == 255


def test_orientation_of_jpeg():
    tiff = b"II*\x00\x08\x00\x00\x00" + b"\x01\x00" + b"\x12\x01\x03\x00\x01\x00\x00\x00\x06\x00\x00\x00"
    body = b"Exif\x00\x00" + tiff
    assert orientation(b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body) == 6
    assert orientation(b"no jpeg") == 1
    a = np.arange(6, dtype=np.uint8).reshape(1, 2, 3)
    assert upright(a, 6).shape == (2, 1, 3) and (upright(a, 3) == a[:, ::-1]).all()


def test_png_is_read_by_the_image_source(spark, tmp_path):
    from rankloom.sources.captures import read_images, uploads

    a = np.zeros((4, 6, 3), np.uint8)
    a[:, :, 0] = 200
    (tmp_path / "a.png").write_bytes(X.png(a))
    (tmp_path / "b.png").write_bytes(b"no image")
    row = read_images(spark, str(tmp_path)).collect()
    assert len(row) == 1 and (X.as_array(row[0].height, row[0].width, row[0].nChannels, bytes(row[0].data)) == a).all()
    assert uploads(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        uploads(spark, str(tmp_path), most=1)
