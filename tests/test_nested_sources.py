import json

from rankloom.operators.nested import LEVELS, level_table, node_table
from rankloom.operators.words import words_of
from rankloom.plans.pipeline import process
from rankloom.sources.captures import ANNOTATION, line_annotation, not_stored, read_captures, read_text, write_captures
from rankloom.streaming.captures import stream_players


def box(x, y):
    return {"vertices": [{"x": x - 20, "y": y - 10}, {"x": x + 20, "y": y + 10}]}


def word(text, x, y):
    return {"symbols": [{"text": c, "bounding_box": None} for c in text], "boundingbox": None, "bounding_box": box(x, y)}


def tree(*words):
    return {"text": "", "pages": [{"width": 1, "height": 2, "blocks": [{"paragraphs": [{"words": list(words), "boundingbox": None}], "boundingbox": None}]}]}


def test_levels_with_gaps(spark):
    holes = {"text": None, "pages": [None, {"width": None, "height": None, "blocks": []}, {"width": 1, "height": 1, "blocks": [{"paragraphs": None, "boundingbox": None}]}]}
    odd = tree({"symbols": [{"text": " a", "bounding_box": None}, {"text": None, "bounding_box": None}, None, {"text": "b ", "bounding_box": None}], "boundingbox": None, "bounding_box": None}, None)
    df = spark.createDataFrame([(1, holes, 0), (2, None, 0), (3, odd, 0)], f"capture_id bigint, annotation {ANNOTATION}, page_ord int")
    got = sorted(tuple(r) for r in node_table(df).collect())
    assert got == [
        (1, 0, -1, -1, -1, ""), (1, 1, -1, -1, -1, ""), (1, 2, -1, -1, -1, ""), (1, 2, 0, -1, -1, ""),
        (3, 0, -1, -1, -1, ""), (3, 0, 0, -1, -1, ""), (3, 0, 0, 0, -1, ""), (3, 0, 0, 0, 0, " ab "), (3, 0, 0, 0, 1, ""),
    ]
    assert [level_table(df, n).count() for n in LEVELS] == [4, 2, 1, 2, 4]
    assert node_table(df.limit(0)).count() == 0


def test_words_are_in_reading_order(spark):
    df = spark.createDataFrame([(1, tree(word("low", 5, 50), word("right", 90, 10), word("left", 10, 10), word("  ", 1, 1)))], f"capture_id bigint, annotation {ANNOTATION}")
    assert [(r.ord, r.text, r.avg_x) for r in words_of(df).orderBy("ord").collect()] == [(0, "left", 10.0), (1, "right", 90.0), (2, "low", 5.0)]


def capture(name):
    a = tree(word("Weekly", 50, 30), word("Rank", 100, 30), word("Bob", 300, 500), word("5,000", 700, 500))
    return (name, "h", 1080, 2400, a, None)


SCHEMA = f"source_file string, image_hash string, image_width int, image_height int, annotation {ANNOTATION}, text_blocks array<struct<text:string,bbox:struct<vertices:array<struct<x:int,y:int>>>,avg_x:double,avg_y:double>>"


def test_captures_round_trip_and_pipeline(spark, tmp_path):
    df = spark.createDataFrame([capture("a"), capture("b")], SCHEMA)
    write_captures(df, str(tmp_path / "c"))
    back = read_captures(spark, str(tmp_path / "c"), multiline=False)
    assert sorted(back.collect()) == sorted(df.collect())
    assert "boundingBox" not in back.schema.simpleString()
    assert not_stored(df, back.filter("source_file = 'a'")).count() == 1 and not_stored(df, back, force=True).count() == 2
    got = process(back, key="source_file").collect()
    assert sorted((r.image_id, r.player_name, r.score, r.category) for r in got) == [("a", "Bob", 5000, "weekly"), ("b", "Bob", 5000, "weekly")]
    assert {r.category for r in process(back, override="friday", key="source_file").collect()} == {"friday"}


def test_stream_counts_each_file_once(spark, tmp_path):
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    for n in "ab":
        name, h, w, t, a, _ = capture(n)
        text = json.dumps({"source_file": name, "image_hash": h, "image_width": w, "image_height": t, "annotation": a}).replace('"boundingbox"', '"boundingBox"')
        (src / f"{n}.json").write_text(text)
        stream_players(spark, str(src), str(out), str(check), once=True).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 2


def test_engine_failures_give_null(spark):
    images = spark.createDataFrame([(1, 1, 1, 3, bytearray(3)), (2, 1, 1, 3, bytearray(b"\xff\xff\xff")), (3, -1, -1, 3, None)], "image_id int, height int, width int, nChannels int, data binary")

    def engine():
        def read(a):
            if a.max() == 0:
                raise RuntimeError("no text")
            return line_annotation([([(0, 0), (4, 2)], "ok"), ([], " ")])

        return read

    got = {r.image_id: r.annotation is not None for r in read_text(images, engine).collect()}
    assert got == {1: False, 2: True, 3: False}
