"""Queries on settings: definitions of screens as JSON, made for the rows of a table, read and laid out flat."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ready
from ..config import CATEGORIES, Constants, Hint, Screen, check_screen, parse, screen_of
from .inputs import load

#: A definition for each nation, which leaves out now this and now that; in SQL that both engines read.
DEFINITIONS = """
SELECT CAST(n_nationkey AS BIGINT) AS id, CONCAT('{"id": "s', n_nationkey, '", "title": "', n_name, '"',
  CASE WHEN n_nationkey % 2 = 0 THEN CONCAT(', "priority": ', n_nationkey * 10) ELSE '' END,
  CASE WHEN n_nationkey % 3 = 0 THEN ', "page_signals": ["Daily Rank", "Rank"], "negative_signals": ["Mon."]' ELSE '' END,
  CASE WHEN n_nationkey % 4 = 0 THEN CONCAT(', "row_clustering": {"min_score": ', 500 + n_nationkey, ', "unknown": 1, "score_anchored": {"up_band_fraction": 0.03}}') ELSE '' END,
  CASE WHEN n_nationkey % 4 = 1 THEN ', "row_clustering": {"strategy": "y_proximity", "y_proximity": {"min_tolerance_px": 33}, "word_gap_fraction": 0.02}' ELSE '' END,
  CASE WHEN n_nationkey % 5 = 0 THEN ', "tabs": {"items": [{"category": "power", "signals": ["Power"]}, {"category": "kills", "signals": ["Kills"], "group": "g"}], "groups": {"g": {"strategy": "brightest"}}}' ELSE '' END,
  CASE WHEN n_nationkey % 5 = 1 THEN CONCAT(', "tabs": {"items": [{"category": "weekly"}], "active_indicator": {"min_gap": 0.08, "color": {"name": "orange", "hsv_override": {"h_min": 0.1, "v_min": 0.', n_nationkey + 10, '}}}}') ELSE '' END,
  CASE WHEN n_nationkey % 6 = 0 THEN ', "pre_ocr_hint": {"min_fraction": 0.25, "region": {"x": 0.1, "height": 0.5}}, "chrome": {"top": {"text": "Ranking"}, "bottom": {"text": "Your Alliance", "edge": "top"}}' ELSE '' END,
  CASE WHEN n_nationkey % 7 = 0 THEN ', "columns": [{"name": "score", "x_min": 0.7, "kind": "number"}, {"name": "name", "x_max": 0.6}]' ELSE '' END,
  '}') AS definition
FROM nation
"""
_FLAT = {
    "screen": "string", "title": "string", "priority": "int", "page_signals": "int", "negative_signals": "int", "strategy": "string", "up_band": "double", "down_band": "double", "tolerance": "double",
    "tolerance_px": "int", "min_score": "int", "gap": "double", "gap_px": "int", "tabs": "int", "first_category": "string", "first_signals": "int", "last_group": "string", "group_strategy": "string",
    "group_fraction": "double", "active_strategy": "string", "active_fraction": "double", "min_gap": "double", "padding": "double", "color": "string", "h_min": "double", "h_max": "double",
    "s_min": "double", "v_min": "double", "hint_fraction": "double", "hint_x": "double", "hint_width": "double", "hint_height": "double", "chrome_top": "string", "chrome_top_edge": "string",
    "chrome_bottom_edge": "string", "columns": "int", "column": "string", "column_kind": "string", "column_x_min": "double", "column_x_max": "double",
}


def flat(s: Screen) -> tuple:
    """One row with what a definition says, or its defaults; null where a part that has no default is left out."""
    r, t, h, c = s.row_clustering, s.tabs, s.pre_ocr_hint or Hint(), s.chrome
    ai = t.active_indicator if t else None
    first, last = (t.items[0], t.items[-1]) if t and t.items else (None, None)
    group = next(iter(t.groups.values()), None) if t else None
    region, column = h.region, s.columns[0] if s.columns else None
    of = lambda x, name: getattr(x, name) if x is not None else None
    return (
        s.id, s.title, s.priority, len(s.page_signals), len(s.negative_signals), r.strategy, r.score_anchored.up_band_fraction, r.score_anchored.down_band_fraction, r.y_proximity.tolerance_fraction,
        r.y_proximity.min_tolerance_px, r.min_score, r.word_gap_fraction, r.min_word_gap_px, len(t.items) if t else None, of(first, "category"), len(first.signals) if first else None, of(last, "group"), of(group, "strategy"),
        of(group, "min_fraction"), of(ai, "strategy"), of(ai, "min_fraction"), of(ai, "min_gap"), of(ai, "bbox_padding_fraction"), of(of(ai, "color"), "name"), *([ai.hsv.h_min, ai.hsv.h_max, ai.hsv.s_min, ai.hsv.v_min] if ai else [None] * 4),
        h.min_fraction if s.pre_ocr_hint else None, of(region, "x"), of(region, "width"), of(region, "height"), of(of(c, "top"), "text"), of(of(c, "top"), "edge"),
        of(of(c, "bottom"), "edge"), len(s.columns), of(column, "name"), of(column, "kind"), of(column, "x_min"), of(column, "x_max"),
    )


def read_definitions(definitions: DataFrame) -> DataFrame:
    """(id, and the fields of a screen) of each JSON definition; RuntimeError for one that is no screen."""
    ready(definitions.sparkSession)
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                given = json.loads(text)
                check_screen(given, str(n))
                rows.append(flat(parse(Screen, given)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], kinds[t]) for k, t in enumerate(_FLAT.values())]], names=["id", *_FLAT])

    return definitions.select("id", "definition").mapInArrow(run, "id bigint, " + ", ".join(f"`{n}` {t}" for n, t in _FLAT.items()))


def screen_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return read_definitions(load(spark, sf, DEFINITIONS.replace("{", "{{").replace("}", "}}"), "nation"))


def category_screens(spark: SparkSession, sf: str) -> DataFrame:
    """How many entries of each known category there are, with the screen whose settings their rows are read by (null: defaults)."""
    known = spark.createDataFrame([(c, s.id if (s := screen_of(c)) else None) for c in CATEGORIES], "category string, screen string")
    e = spark.read.parquet(f"{sf}/player_entry.parquet").filter("category is not null")
    return e.groupBy("category").agg(F.count("*").alias("entries")).join(F.broadcast(known), "category")


def constants(spark: SparkSession, sf: str) -> DataFrame:
    """The groups of constants with their defaults, one row for each value."""
    c = Constants()
    groups = {"window": c.window, "orange": c.orange, "orange_hsv": c.orange_hsv}
    rows = [(g, n, float(v)) for g, d in groups.items() for n, v in vars(d).items()] + [("white", "min_channel", float(c.white_min_channel))]
    return spark.createDataFrame(rows, "part string, name string, value double")


QUERIES = {"screen_definitions": screen_definitions, "category_screens": category_screens, "constants": constants}


def _at(path: str, kind: str, default: str = "NULL") -> str:
    read = f"json_extract_string(j, '$.{path}')"
    return f"coalesce({read if kind == 'VARCHAR' else f'CAST({read} AS {kind})'}, {default})"


def _if(part: str, value: str) -> str:
    return f"CASE WHEN json_exists(j, '$.{part}') THEN {value} END"


_D, _I, _S = "DOUBLE", "INTEGER", "VARCHAR"
_AI, _HSV = "tabs.active_indicator", "tabs.active_indicator.color.hsv_override"
_COUNT = lambda p: f"CAST(coalesce(json_array_length(j, '$.{p}'), 0) AS INTEGER)"
_SQL = {
    "screen": _at("id", _S), "title": _at("title", _S, "''"), "priority": _at("priority", _I, "99"), "page_signals": _COUNT("page_signals"), "negative_signals": _COUNT("negative_signals"),
    "strategy": _at("row_clustering.strategy", _S, "'score_anchored'"), "up_band": _at("row_clustering.score_anchored.up_band_fraction", _D, "CAST(0.021 AS DOUBLE)"), "down_band": "CAST(0.002 AS DOUBLE)", "tolerance": "CAST(0.02 AS DOUBLE)",
    "tolerance_px": _at("row_clustering.y_proximity.min_tolerance_px", _I, "20"), "min_score": _at("row_clustering.min_score", _I, "1000"), "gap": _at("row_clustering.word_gap_fraction", _D, "CAST(0.015 AS DOUBLE)"), "gap_px": "8",
    "tabs": _if("tabs", _COUNT("tabs.items")), "first_category": _at("tabs.items[0].category", _S), "first_signals": _if("tabs", _COUNT("tabs.items[0].signals")), "last_group": _at("tabs.items[1].group", _S),
    "group_strategy": _at("tabs.groups.g.strategy", _S), "group_fraction": _if("tabs.groups", "CAST(0.10 AS DOUBLE)"), "active_strategy": _if("tabs", "'color_fraction'"), "active_fraction": _if("tabs", "CAST(0.10 AS DOUBLE)"),
    "min_gap": _if("tabs", _at(f"{_AI}.min_gap", _D, "CAST(0.04 AS DOUBLE)")), "padding": _if("tabs", "CAST(0.007 AS DOUBLE)"), "color": _at(f"{_AI}.color.name", _S),
    "h_min": _if("tabs", _at(f"{_HSV}.h_min", _D, "CAST(0.014 AS DOUBLE)")), "h_max": _if("tabs", "CAST(0.153 AS DOUBLE)"), "s_min": _if("tabs", "CAST(0.40 AS DOUBLE)"), "v_min": _if("tabs", _at(f"{_HSV}.v_min", _D, "CAST(0.55 AS DOUBLE)")),
    "hint_fraction": _at("pre_ocr_hint.min_fraction", _D), "hint_x": _at("pre_ocr_hint.region.x", _D), "hint_width": _if("pre_ocr_hint", "CAST(1.0 AS DOUBLE)"), "hint_height": _at("pre_ocr_hint.region.height", _D),
    "chrome_top": _at("chrome.top.text", _S), "chrome_top_edge": _if("chrome", "'bottom'"), "chrome_bottom_edge": _at("chrome.bottom.edge", _S), "columns": _COUNT("columns"), "column": _at("columns[0].name", _S),
    "column_kind": _at("columns[0].kind", _S), "column_x_min": _at("columns[0].x_min", _D), "column_x_max": _if("columns", "CAST(1.0 AS DOUBLE)"),
}
_SCREENS = {"daily_ranking": "'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday'", "weekly_ranking": "'weekly'", "strength_metrics": "'power', 'kills'", "strength_donation": "'donation_daily', 'donation_weekly'"}
_KNOWN = ", ".join(repr(c) for c in CATEGORIES)
SQL = {
    "screen_definitions": f"WITH d AS (SELECT id, CAST(definition AS JSON) AS j FROM ({DEFINITIONS}) AS t) SELECT id, " + ", ".join(f'{v} AS "{k}"' for k, v in _SQL.items()) + " FROM d",
    "category_screens": f"""
SELECT category, count(*) AS entries, CASE {' '.join(f"WHEN category IN ({c}) THEN '{s}'" for s, c in _SCREENS.items())} END AS screen FROM player_entry WHERE category IN ({_KNOWN}) GROUP BY category""",
    "constants": """
SELECT part, name, CAST(value AS DOUBLE) AS value FROM (VALUES ('window', 'near_black_max_channel', 20), ('window', 'border_coverage_threshold', 0.95), ('window', 'sample_count', 64), ('window', 'min_window_fraction', 0.2),
  ('window', 'bbox_padding_fraction', 0.02), ('orange', 'r_min', 180), ('orange', 'g_min', 60), ('orange', 'g_max', 180), ('orange', 'b_max', 90), ('orange_hsv', 'h_min', 0.014), ('orange_hsv', 'h_max', 0.153),
  ('orange_hsv', 's_min', 0.4), ('orange_hsv', 'v_min', 0.55), ('white', 'min_channel', 215)) AS v(part, name, value)""",
}
