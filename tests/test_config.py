import json

import pytest

from rankloom.config import RowClustering, Screen, check_screen, default_screens, load_screens, parse, rows_of, screen, screen_of


def test_defaults_fill_what_is_left_out():
    s = parse(Screen, {"id": "x", "tabs": {"items": [{"category": "a", "signals": ["A"]}], "active_indicator": {"color": {"hsv_override": {"h_min": 0.1}}}}, "row_clustering": {"min_score": 5}, "unknown": 1})
    assert s.priority == 99 and s.tabs.active_indicator.hsv.h_min == 0.1 and s.tabs.active_indicator.hsv.s_min == 0.40
    assert s.row_clustering.min_score == 5 and s.row_clustering.score_anchored.up_band_fraction == 0.021


def test_bands_and_gap():
    assert RowClustering().bands(2400) == (50, 4) and RowClustering().bands(10) == (1, 1)
    assert RowClustering().gap(1080) == 16 and RowClustering().gap(0) == 16 and RowClustering().gap(100) == 8


def test_screens_of_categories():
    assert screen_of("friday").id == "daily_ranking" and screen_of("siege_daily") is None and rows_of("siege_daily") == RowClustering()
    assert screen("nowhere") is None and [s.priority for s in default_screens()] == sorted(s.priority for s in default_screens())


def test_load_and_check(tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"id": "b", "priority": 2}))
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "priority": 5}))
    assert [s.id for s in load_screens(tmp_path)] == ["b", "a"]
    for bad in ({}, {"id": "x", "page_signals": "no"}, {"id": "x", "tabs": {"items": [{}]}}):
        with pytest.raises(RuntimeError):
            check_screen(bad)
