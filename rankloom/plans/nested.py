"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.nested import LEVELS, level_table, node_table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return node_table(spark.read.parquet(f"{sf}/fixture.parquet"))


def _level(level: str):
    return lambda spark, sf: level_table(spark.read.parquet(f"{sf}/fixture.parquet"), level)


QUERIES = {"p5_found": p5_found} | {f"p5_{level}": _level(level) for level in LEVELS}

_UNNEST = """
WITH pg AS (
  SELECT capture_id, unnest(range(len(annotation.pages))) AS page_ord, unnest(annotation.pages) AS n FROM fixture),
bl AS (
  SELECT capture_id, page_ord, unnest(range(len(n.blocks))) AS block_ord, unnest(n.blocks) AS n FROM pg),
pa AS (
  SELECT capture_id, page_ord, block_ord, unnest(range(len(n.paragraphs))) AS para_ord, unnest(n.paragraphs) AS n FROM bl),
wo AS (
  SELECT capture_id, page_ord, block_ord, para_ord, unnest(range(len(n.words))) AS word_ord, unnest(n.words) AS n FROM pa),
sy AS (
  SELECT capture_id, page_ord, block_ord, para_ord, word_ord, unnest(range(len(n.symbols))) AS symbol_ord, unnest(n.symbols) AS n FROM wo)
"""
_TEXT = "coalesce(array_to_string(list_filter(list_transform(n.symbols, lambda s: s.text), lambda t: t IS NOT NULL), ''), '')"


def _edges(vertices: str) -> str:
    return ", ".join(
        f"list_{f}(list_transform({vertices}, lambda v: v.{a})) AS {f}_{a}" for a in "xy" for f in ("min", "max")
    )


def _at(*names: str) -> str:
    return ", ".join(f"CAST({n} AS INTEGER) AS {n}" for n in names)


_O = ("page_ord", "block_ord", "para_ord", "word_ord", "symbol_ord")
SQL = {
    "p5_found": _UNNEST
    + f"""
SELECT capture_id, {_at('page_ord')}, -1 AS block_ord, -1 AS para_ord, -1 AS word_ord, '' AS word_text FROM pg
UNION ALL SELECT capture_id, {_at(*_O[:2])}, -1, -1, '' FROM bl
UNION ALL SELECT capture_id, {_at(*_O[:3])}, -1, '' FROM pa
UNION ALL SELECT capture_id, {_at(*_O[:4])}, {_TEXT} FROM wo""",
    "p5_pages": _UNNEST + f"SELECT capture_id, {_at(*_O[:1])}, n.width AS width, n.height AS height FROM pg",
    "p5_blocks": _UNNEST + f"SELECT capture_id, {_at(*_O[:2])}, {_edges('n.boundingbox.vertices')} FROM bl",
    "p5_paragraphs": _UNNEST + f"SELECT capture_id, {_at(*_O[:3])}, {_edges('n.boundingbox.vertices')} FROM pa",
    "p5_words": _UNNEST
    + f"SELECT capture_id, {_at(*_O[:4])}, {_TEXT} AS word_text, {_edges('coalesce(n.boundingbox, n.bounding_box).vertices')} FROM wo",
    "p5_symbols": _UNNEST
    + f"SELECT capture_id, {_at(*_O)}, n.text AS symbol_text, {_edges('n.bounding_box.vertices')} FROM sy",
}
