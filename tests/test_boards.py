import pytest
from pyspark.sql import functions as F

from rankloom.config import CATEGORIES
from rankloom.operators import boards as B
from rankloom.operators.classify import classify
from rankloom.operators.players import extract_players
from rankloom.operators.rows import parsed_rows, row_members
from rankloom.operators.words import box_of_text, without_noise


def read(df):
    return [(r.player_name, r.score) for r in df.orderBy("image_id", "anchor_ord").collect()]


def test_band_takes_the_name_and_leaves_the_line_below(words):
    w = words(("Bob", 300, 470), ("5,000", 700, 500), ("Alliance", 300, 530))
    assert [r.text for r in row_members(w).orderBy("member_pos").collect()] == ["Bob", "5,000"]


def test_words_right_of_the_score_are_no_name(words):
    w = words(("Bob", 100, 500), ("5,000", 400, 500), ("Extra", 800, 500))
    assert parsed_rows(row_members(w), 1080).first().raw_name == "Bob"


def test_gap_decides_on_the_space(words):
    near, far = words(("Iron", 100, 500), ("Wolf", 145, 500), ("5,000", 700, 500)), words(("Iron", 100, 500), ("Wolf", 200, 500), ("5,000", 700, 500))
    assert parsed_rows(row_members(near), 1080).first().raw_name == "IronWolf"
    assert parsed_rows(row_members(far), 1080).first().raw_name == "Iron Wolf"


def test_merged_word_is_repaired_by_its_neighbours(words):
    w = words(("First", 100, 400), ("500,000", 700, 400), ("Name23,000", 300, 600), ("Last", 100, 800), ("10,000", 700, 800))
    assert read(extract_players(w)) == [("First", 500000), ("Name", 23000), ("Last", 10000)]
    c = extract_players(w).filter("candidates is not null").first().candidates
    assert [(x.player_name, x.score) for x in c] == [("Name2", 3000), ("Name", 23000)]


def test_a_visible_rank_loses_a_merged_row(words):
    assert read(extract_players(words(("2", 60, 600), ("Name23,000", 300, 600)))) == []


def test_noise_and_empty_words(spark, words):
    w = words(("x", 1, 1), ("7", 1, 1), (" ", 1, 1), ("Ranking", 1, 1), ("Bob", 1, 1))
    assert sorted(r.text for r in without_noise(w).collect()) == ["7", "Bob"]
    assert extract_players(w.limit(0)).count() == 0


def test_order_of_words_and_offset_change_nothing(words):
    w = words(("First", 100, 400), ("500,000", 700, 400), ("Iron", 100, 600), ("Wolf", 300, 600), ("9,999", 700, 600))
    moved = w.withColumn("avg_y", F.col("avg_y") + 777).orderBy(F.desc("ord"))
    assert read(extract_players(w)) == read(extract_players(moved)) == [("First", 500000), ("Iron Wolf", 9999)]


def test_printed_box(spark):
    df = spark.createDataFrame([("vertices {\n  x: 4\n  y: 5\n}\nvertices {\n  x: -1\n  y: 9\n}",), ("nothing",), (None,)], "s string")
    assert [r.b and tuple(r.b) for r in df.select(box_of_text(F.col("s")).alias("b")).collect()] == [(-1, 5, 4, 9), None, None]


def test_rules_of_classification(spark, words):
    texts = {1: "STRENGTH RANKING Power", 2: "Alliance Contribution", 3: "Weekly Rank", 4: "Mon. Fri Sat.", 5: "Weekly Rank Mon.", 6: "Hello"}
    w = None
    for i, t in texts.items():
        one = words(*[(x, 1, 1) for x in t.split()], image_id=i)
        w = one if w is None else w.unionByName(one)
    got = {r.image_id: (r.category, r.confidence, r.rule) for r in classify(w).collect()}
    assert got[1] == ("power", 1.0, "strength") and got[2] == (None, 0.0, "alliance") and got[3] == ("weekly", 1.0, "weekly")
    assert got[4] == ("friday", 0.75, "day_by_text") and got[5] == ("monday", 0.75, "day_by_text") and got[6] == (None, 0.0, "none")


def test_categories_and_override(spark):
    p = spark.createDataFrame([(1, 1, "a", 5), (1, 0, "b", 9), (2, 0, "c", 1)], "image_id int, anchor_ord int, player_name string, score long")
    c = spark.createDataFrame([(1, "friday"), (2, "nonsense")], "image_id int, category string")
    known = B.with_category(p, c)
    assert [r.player_name for r in B.leaderboard(known).orderBy("category", "place").collect()] == ["b", "a"]
    assert B.response(known).first().entries == '[{"player_name":"b","score":9},{"player_name":"a","score":5}]'
    assert B.with_category(p, c, "weekly").count() == 3 and len(CATEGORIES) == 23
    with pytest.raises(ValueError):
        B.with_category(p, c, "nonsense")
