import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T


@pytest.fixture
def value(spark):
    def of(f, *given):
        df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, s string")
        return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]

    return of


def test_strip_takes_all_white_space(value):
    assert value(T.strip, " a\t\n", "　x y ", "", None) == ["a", "x y", "", None]


def test_tags_and_ranks(value):
    assert value(T.strip_alliance_tag, "[ZaPp] Bob", "(Tag]Bob", "[]Bob", "[twelve chars]Bob") == ["Bob", "Bob", "[]Bob", "[twelve chars]Bob"]
    assert value(T.strip_leading_rank, "1. Bob", "100Max", "1234Max", "x1") == ["Bob", "Max", "4Max", "x1"]
    assert value(T.strip_rank_badge, "R4 Bob", "Bob R1", "R9 Bob", "AR1 B") == ["Bob", "Bob", "R9 Bob", "AR1 B"]


def test_bare_tags_stay_if_nothing_else_is_left(value):
    assert value(T.strip_bare_tags, "ZaPp Bobby", "ZaPp", "FF7 Bob", "CoRe ZaPp") == ["Bobby", "ZaPp", "FF7 Bob", "CoRe ZaPp"]


def test_clean_player_name(value):
    given = ["48 R4 [ZaPp] Shodan", "[ZaPp] Max Pantheon of Wrath", "Bob [TAG] Pantheon of Wrath", "กBobฟ", "Pàcha!", "12 CoRe", "R4 48 X", None]
    assert value(T.clean_player_name, *given) == ["Shodan", "Max", "Bob", "Bob", "Pàcha", "", "48 X", None]


def test_scores(value):
    assert value(T.parse_score, "161,528,090", "16l,528,O90", "Points", "1.5", "1_000", "", "9" * 19, None) == [161528090, 161528090, None, None, None, None, None, None]
    assert value(T.is_numeric_token, " 1,2 ", ",", "1a", "") == [True, True, False, False]


def test_crash_splits_by_score(value):
    assert [tuple(s)[:2] for s in value(T.crash_splits, "Name54323,045,000")[0]] == [("Name5432", "3,045,000"), ("Name543", "23,045,000"), ("Name54", "323,045,000")]
    assert value(T.crash_split, "3,045,000", "NoScore", "a,b1,000") == [None, None, None]
    assert [s["name"] for s in value(T.crash_splits, "A01,234")[0]] == ["A0", "A"]


def test_day_and_labels(value):
    assert value(T.day_of_label, "Thur.", "FRI", " monday ", "Points", None) == ["thursday", "friday", "monday", None, None]
    assert value(T.is_ui_label, " Ranking", "Bob") == [True, False]
