"""An engine that fails on a stitched image: it is told from one that reads nothing, and no batch comes without its players."""

import pytest

from rankloom.operators import pixels as X
from rankloom.operators.layout import stitch_layout
from rankloom.operators.stitching import cropped, read_stitched
from rankloom.plans import batches
from rankloom.plans.pipeline import process_batch

WIDE = 288


def engine_that(how):
    """The stand-in engine, which on wide stitched images raises, gives back what is no annotation, or reads nothing."""

    def engine():
        read = batches.reader()

        def one(a):
            if a.shape[1] != WIDE:
                return read(a)
            if how == "raises":
                raise RuntimeError("quota exceeded")
            return {"error": {"message": "quota exceeded"}} if how == "refuses" else None

        return one

    return engine


def screens(spark):
    """Three batches: one wide and two narrow screens, two narrow ones, a wide one."""
    rows = [(k // 3, k, *a.shape, X.as_bytes(a)) for k in (0, 1, 2, 4, 5, 6) for a in [batches.drawn(k)]]
    return spark.createDataFrame(rows, "batch_id long, image_seq long, height int, width int, nChannels int, data binary")


@pytest.mark.parametrize("how", ["raises", "refuses", "reads nothing"])
def test_failures_are_told_from_nothing_read(spark, how):
    images = cropped(screens(spark))
    got = read_stitched(images, stitch_layout(images.drop("data")), engine_that(how), stretch=False).collect()
    wide, narrow = [r for r in got if r.width == WIDE], [r for r in got if r.width != WIDE]
    assert len(wide) == 2 and all(r.annotation is None for r in wide)
    assert {r.error is None for r in wide} == {how == "reads nothing"} and all("error" in r.error.lower() for r in wide if r.error)
    assert len(narrow) == 2 and all(r.annotation is not None and r.error is None for r in narrow)


@pytest.mark.parametrize("how", ["raises", "refuses"])
def test_a_batch_does_not_come_without_the_images_that_failed(spark, how):
    with pytest.raises(RuntimeError, match=r"failed on 2 of 4 stitched images: batch 0, 288 x 480 from 0: \w+Error: .*; batch 2, "):
        process_batch(screens(spark), engine_that(how), stretch=False)


def test_images_without_text_are_no_failure(spark):
    players = process_batch(screens(spark), engine_that("reads nothing"), stretch=False)
    assert {r.image_seq for r in players.collect()} == {1, 2, 4, 5}


def test_an_engine_that_cannot_start_ends_the_job(spark):
    def engine():
        raise RuntimeError("no credentials")

    with pytest.raises(Exception, match="no credentials"):
        process_batch(screens(spark), engine, stretch=False)


@pytest.mark.parametrize("query", ["process_batch", "batch_answers"])
def test_queries_end_where_the_engine_fails(spark, sf, monkeypatch, query):
    monkeypatch.setattr(batches, "reader", engine_that("raises"))
    with pytest.raises(RuntimeError, match="quota exceeded"):
        batches.QUERIES[query](spark, sf)


@pytest.mark.parametrize("how", ["raises", "refuses"])
def test_totals_of_an_override_do_not_come_without_the_images_that_failed(spark, sf, monkeypatch, how):
    monkeypatch.setattr(batches, "reader", engine_that(how))
    with pytest.raises(RuntimeError, match=r"the engine failed on \d+ of \d+ stitched images: batch 0, 288 x 480"):
        batches.QUERIES["process_batch_override"](spark, sf)
