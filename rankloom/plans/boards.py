"""Queries on words, rows and players."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.players import extract_players, read_rows
from ..operators.rows import parsed_rows, row_members
from ..operators.words import blocks_of, box_of_text, is_score, without_noise, words_of
from . import duck as D
from .inputs import LEADERBOARD, leaderboard
from .inputs import duck as duck_sql

HEIGHT, WIDTH = 2400, 1080
TALL = 5200


def words_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return words_of(spark.read.parquet(f"{sf}/fixture.parquet"))


def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks_of(spark.read.parquet(f"{sf}/fixture.parquet"))


def printed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    w = leaderboard(spark, sf)
    text = F.format_string("vertices {\n  x: %d\n  y: %d\n}\nvertices {\n  x: %d\n  y: %d\n}\n", "left_x", "top_y", "right_x", "bottom_y")
    return w.select("image_id", "ord", box_of_text(text).alias("b")).select("image_id", "ord", "b.*")


def filter_noise_words(spark: SparkSession, sf: str) -> DataFrame:
    return without_noise(words_of(spark.read.parquet(f"{sf}/fixture.parquet"))).select("image_id", "ord", "text")


def score_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return leaderboard(spark, sf).filter(is_score(F.col("text"), 1000)).select("image_id", "ord", "text", "avg_y")


def row_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return row_members(without_noise(leaderboard(spark, sf)), TALL).select("image_id", "anchor_ord", "member_pos", "ord", "text")


def parse_rows(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_rows(row_members(without_noise(leaderboard(spark, sf)), HEIGHT), WIDTH).drop("splits")


def player_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read_rows(leaderboard(spark, sf), HEIGHT, WIDTH).drop("splits")


def _players(spark: SparkSession, sf: str) -> DataFrame:
    return extract_players(leaderboard(spark, sf), HEIGHT, WIDTH)


def players(spark: SparkSession, sf: str) -> DataFrame:
    return _players(spark, sf).drop("candidates")


def players_tall(spark: SparkSession, sf: str) -> DataFrame:
    """The same words as if the image were taller, so that the bands of neighbouring rows overlap."""
    return extract_players(leaderboard(spark, sf), TALL, WIDTH).drop("candidates")


def players_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = _players(spark, sf).select("image_id", "anchor_ord", F.posexplode("candidates").alias("pos", "c"))
    return c.select("image_id", "anchor_ord", "pos", "c.player_name", "c.score")


def bounds_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose name and score were replaced, with what was read first."""
    read = read_rows(leaderboard(spark, sf), HEIGHT, WIDTH).select("image_id", "anchor_ord", F.col("name").alias("read_name"), F.col("score").alias("read_score"))
    both = _players(spark, sf).join(read, ["image_id", "anchor_ord"])
    return both.filter("score <> read_score").select("image_id", "anchor_ord", "read_name", "read_score", "player_name", "score")


def capture_players(spark: SparkSession, sf: str) -> DataFrame:
    """Players of all captures, from their annotations."""
    f = spark.read.parquet(f"{sf}/fixture.parquet")
    w = words_of(f).join(f.select(F.col("capture_id").alias("image_id"), "image_height", "image_width"), "image_id")
    return extract_players(w, F.col("image_height"), F.col("image_width")).drop("candidates")


QUERIES = {
    "words_flatten": words_flatten, "text_blocks": text_blocks, "printed_boxes": printed_boxes, "filter_noise_words": filter_noise_words, "score_anchors": score_anchors, "row_cluster": row_cluster, "parse_rows": parse_rows,
    "player_rows": player_rows, "extract_players": players, "extract_players_tall": players_tall, "players_candidates": players_candidates, "bounds_repair": bounds_repair,
}

_WORDS = duck_sql(LEADERBOARD)


def flat(key: str = "image_id") -> str:
    """Common table expressions up to ``w``: the words of the fixture table in reading order."""

    def coordinate(f: str, a: str) -> str:
        return f"list_{f}(list_transform(v, lambda z: coalesce(z.{a}, 0)))"

    text = "array_to_string(list_filter(list_transform(n.symbols, lambda s: s.text), lambda t: t IS NOT NULL), '')"
    return f"""
pg AS (SELECT capture_id, unnest(range(len(annotation.pages))) AS p, unnest(annotation.pages) AS n FROM fixture),
bl AS (SELECT capture_id, p, unnest(range(len(n.blocks))) AS b, unnest(n.blocks) AS n FROM pg),
pa AS (SELECT capture_id, p, b, unnest(range(len(n.paragraphs))) AS g, unnest(n.paragraphs) AS n FROM bl),
wo AS (SELECT capture_id, p, b, g, unnest(range(len(n.words))) AS k, unnest(n.words) AS n FROM pa),
wt AS (SELECT capture_id, p, b, g, k, {D.strip(f"coalesce({text}, '')")} AS text, coalesce(n.boundingbox, n.bounding_box).vertices AS v FROM wo),
we AS (SELECT *, CASE WHEN len(v) > 0 THEN CAST({coordinate('sum', 'x')} AS DOUBLE) / len(v) ELSE 0.0 END AS avg_x,
  CASE WHEN len(v) > 0 THEN CAST({coordinate('sum', 'y')} AS DOUBLE) / len(v) ELSE 0.0 END AS avg_y FROM wt WHERE text <> ''),
w AS (SELECT capture_id AS {key}, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY avg_y, avg_x, p, b, g, k) - 1 AS INTEGER) AS ord, text, avg_x, avg_y,
  {coordinate('min', 'x')} AS left_x, {coordinate('max', 'x')} AS right_x, {coordinate('min', 'y')} AS top_y, {coordinate('max', 'y')} AS bottom_y FROM we)"""


def board(words: str = _WORDS, up: int | str = 50, down: int | str = 4, gap: int | str = 16, edges: bool = False) -> str:
    """Common table expressions from words to players: m (members), r (read rows), pre and p. ``edges``: words may lack a box."""
    edge = "* REPLACE (coalesce(left_x, avg_x) AS left_x, coalesce(right_x, avg_x) AS right_x)" if edges else "*"
    return f"""
w AS (SELECT {edge} FROM ({words}) AS given),
q AS (SELECT *, {D.is_score('text')} AS is_score, {D.numeric('text')} AS num, {D.splits('text')} AS sp FROM w WHERE {D.not_noise('text')}),
m0 AS (
  SELECT o.*, a.ord AS anchor_ord FROM q AS o JOIN q AS a ON o.image_id = a.image_id AND a.is_score AND NOT o.is_score AND o.avg_y BETWEEN a.avg_y - {up} AND a.avg_y + {down}
  UNION ALL SELECT *, ord FROM q WHERE is_score),
m AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id, anchor_ord ORDER BY avg_x, is_score, ord) AS INTEGER) AS pos FROM m0),
g AS (
  SELECT image_id, anchor_ord, max(pos) FILTER (num) AS num_at, max(pos) FILTER (len(sp) > 0) AS crash_at FROM m GROUP BY ALL
  HAVING coalesce(max(pos) FILTER (num), max(pos) FILTER (len(sp) > 0)) IS NOT NULL),
s AS (
  SELECT g.*, m.text AS score_text, m.left_x AS score_left, CASE WHEN num_at IS NULL THEN m.sp[1] END AS split, coalesce(c.sp, []) AS splits
  FROM g JOIN m ON m.image_id = g.image_id AND m.anchor_ord = g.anchor_ord AND m.pos = coalesce(num_at, crash_at)
  LEFT JOIN m AS c ON c.image_id = g.image_id AND c.anchor_ord = g.anchor_ord AND c.pos = crash_at),
parts AS (
  SELECT s.image_id, s.anchor_ord, m.pos, m.text, m.left_x AS l, m.right_x AS r FROM s JOIN m ON m.image_id = s.image_id AND m.anchor_ord = s.anchor_ord AND m.pos < coalesce(num_at, crash_at) AND m.right_x <= score_left
  UNION ALL SELECT image_id, anchor_ord, 1000000, split.name, score_left, score_left FROM s WHERE split IS NOT NULL),
gaps AS (SELECT *, lag(r) OVER (PARTITION BY image_id, anchor_ord ORDER BY pos) AS before FROM parts),
names AS (
  SELECT image_id, anchor_ord, string_agg(CASE WHEN before IS NOT NULL AND (l = 0 OR before = 0 OR l - before > {gap}) THEN ' ' ELSE '' END || text, '' ORDER BY pos) AS raw_name FROM gaps GROUP BY ALL),
r AS (
  SELECT s.image_id, s.anchor_ord, {D.strip('raw_name')} AS raw_name, coalesce(split.score_text, score_text) AS raw_score, splits
  FROM s JOIN names USING (image_id, anchor_ord) WHERE {D.strip('raw_name')} <> ''),
{D.clean('r', 'raw_name', 'rc')},
pre AS (SELECT image_id, anchor_ord, nm AS name, {D.score('raw_score')} AS score, splits FROM rc WHERE nm <> '' AND {D.score('raw_score')} >= 1000 AND NOT {D.ui_label('nm')}),
b0 AS (SELECT *, lag(score) OVER (PARTITION BY image_id ORDER BY anchor_ord) AS upper, lead(score) OVER (PARTITION BY image_id ORDER BY anchor_ord) AS lower FROM pre),
alt0 AS (SELECT image_id, anchor_ord, unnest(range(len(splits))) AS k, unnest(splits).name AS sn, unnest(splits).score AS ss FROM b0),
{D.clean('alt0', 'sn', 'alt1')},
alt AS (
  SELECT image_id, anchor_ord, nm AS player_name, ss AS score, CAST(row_number() OVER (PARTITION BY image_id, anchor_ord ORDER BY k) - 1 AS INTEGER) AS pos,
    count(*) OVER (PARTITION BY image_id, anchor_ord) AS n FROM alt1 WHERE nm <> '' AND ss >= 1000 AND NOT {D.ui_label('nm')}),
fit AS (
  SELECT b0.image_id, b0.anchor_ord, arg_min(alt.player_name, alt.pos) AS fit_name, arg_min(alt.score, alt.pos) AS fit_score FROM b0 JOIN alt USING (image_id, anchor_ord)
  WHERE coalesce(alt.score <= upper, true) AND coalesce(alt.score >= lower, true) GROUP BY ALL),
p AS (
  SELECT b0.image_id, b0.anchor_ord, name AS read_name, b0.score AS read_score,
    CASE WHEN bad AND fit_name IS NOT NULL THEN fit_name ELSE name END AS player_name, CASE WHEN bad AND fit_name IS NOT NULL THEN fit_score ELSE b0.score END AS score
  FROM (SELECT *, len(splits) > 0 AND NOT (coalesce(score <= upper, true) AND coalesce(score >= lower, true)) AS bad FROM b0) AS b0 LEFT JOIN fit USING (image_id, anchor_ord))"""


_UP = {HEIGHT: (50, 4), TALL: (109, 10)}
SQL = {
    "words_flatten": f"WITH {flat()} SELECT * FROM w",
    "text_blocks": """
WITH t AS (SELECT capture_id AS image_id, unnest(range(len(text_blocks))) AS ord, unnest(text_blocks) AS b FROM fixture),
u AS (SELECT image_id, CAST(ord AS INTEGER) AS ord, b.text AS text, coalesce(b.avg_x, 0.0) AS avg_x, coalesce(b.avg_y, 0.0) AS avg_y, b.bbox.vertices AS v FROM t WHERE b IS NOT NULL)
SELECT image_id, ord, text, avg_x, avg_y, list_min(list_transform(v, lambda p: coalesce(p.x, 0))) AS left_x, list_max(list_transform(v, lambda p: coalesce(p.x, 0))) AS right_x,
  list_min(list_transform(v, lambda p: coalesce(p.y, 0))) AS top_y, list_max(list_transform(v, lambda p: coalesce(p.y, 0))) AS bottom_y FROM u""",
    "printed_boxes": f"SELECT image_id, ord, left_x, top_y, right_x, bottom_y FROM ({_WORDS}) AS w",
    "filter_noise_words": f"WITH {flat()} SELECT image_id, ord, text FROM w WHERE {D.not_noise('text')}",
    "score_anchors": f"SELECT image_id, ord, text, avg_y FROM ({_WORDS}) AS w WHERE {D.is_score('text')}",
    "row_cluster": f"WITH {board(up=_UP[TALL][0], down=_UP[TALL][1])} SELECT image_id, anchor_ord, pos AS member_pos, ord, text FROM m",
    "parse_rows": f"WITH {board()} SELECT image_id, anchor_ord, raw_name, raw_score FROM r",
    "player_rows": f"WITH {board()} SELECT image_id, anchor_ord, name, score FROM pre",
    "extract_players": f"WITH {board()} SELECT image_id, anchor_ord, player_name, score FROM p",
    "extract_players_tall": f"WITH {board(up=_UP[TALL][0], down=_UP[TALL][1])} SELECT image_id, anchor_ord, player_name, score FROM p",
    "players_candidates": f"WITH {board()} SELECT image_id, anchor_ord, pos, player_name, score FROM alt WHERE n >= 2",
    "bounds_repair": f"WITH {board()} SELECT image_id, anchor_ord, read_name, read_score, player_name, score FROM p WHERE score <> read_score",
}
QUERIES["capture_players"] = capture_players
_TALL, _WIDE = "CAST(coalesce(image_height, 2400) AS DOUBLE)", "CAST(image_width AS DOUBLE)"
_CAPTURE_WORDS = f"""WITH {flat()} SELECT w.*, greatest(1, CAST(trunc(0.021 * {_TALL}) AS INTEGER)) AS up, greatest(1, CAST(trunc(0.002 * {_TALL}) AS INTEGER)) AS down
FROM w JOIN fixture ON capture_id = image_id"""
# the gap between words follows the width of each image
_CAPTURE_GAP = f"(SELECT CASE WHEN coalesce(image_width, 0) = 0 THEN 16 ELSE greatest(8, CAST(trunc(0.015 * {_WIDE}) AS INTEGER)) END FROM fixture WHERE capture_id = image_id)"
SQL["capture_players"] = f"WITH {board(_CAPTURE_WORDS, up='a.up', down='a.down', edges=True, gap=_CAPTURE_GAP)} SELECT image_id, anchor_ord, player_name, score FROM p"
