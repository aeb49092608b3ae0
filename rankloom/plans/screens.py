"""Queries on classification, layout and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORIES
from ..operators import boards as B
from ..operators import classify as C
from ..operators.layout import assign_regions, bbox_window, stitch_layout, sub_batches
from ..operators.players import extract_players
from . import boards as P
from . import duck as D
from .inputs import COLOURS, DAYS, FRAMES, LEADERBOARD, SIGNALS, leaderboard, load
from .inputs import duck as duck_sql


def classify_day_text(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify(load(spark, sf, DAYS, "events"))


def _signal_words(spark: SparkSession, sf: str) -> DataFrame:
    w = load(spark, sf, SIGNALS, "customer")
    return w.select("image_id", F.posexplode(F.split("words", " ")).alias("ord", "text"))


def classify_signals(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify(_signal_words(spark, sf))


def classify_captures(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify(P.words_flatten(spark, sf))


def hsv_orange(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, COLOURS, "part")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.select("p_partkey", F.round(C.hsv(r, g, b)["h"], 9).alias("h"), F.round(C.hsv(r, g, b)["s"], 9).alias("s"), F.round(C.hsv(r, g, b)["v"], 9).alias("v"), C.is_orange(r, g, b).alias("orange"))


def brightness_argmax_gap(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, COLOURS, "part").withColumn("label", F.concat(F.lit("t"), (F.col("p_partkey") % 7).cast("string")))
    v = F.greatest("r", "g", "b") / F.lit(255.0)
    return C.brightest(p.withColumn("v", v), "p_brand", "label", "v", 0.004)


def fixture_category(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.createDataFrame([(c, c) for c in CATEGORIES] + [("donation", "donation_daily")], "key string, category string")
    e = spark.read.parquet(f"{sf}/player_entry.parquet").filter("category is not null")
    names = e.select(F.concat(F.lit("IMG_"), F.upper("category"), F.lit(".json")).alias("name")).distinct()
    return C.category_of_name(names, keys)


def stitch_bisect(spark: SparkSession, sf: str) -> DataFrame:
    return sub_batches(load(spark, sf, FRAMES, "orders"))


def stitch(spark: SparkSession, sf: str) -> DataFrame:
    return stitch_layout(load(spark, sf, FRAMES, "orders"))


def region_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Words spread over the stitched images, one every 1,111 pixels, back to their image."""
    regions = stitch_layout(load(spark, sf, FRAMES, "orders")).withColumn("image_id", F.col("image_seq"))
    keys = ["batch_id", "width", "height", "sub_batch"]
    words = regions.groupBy(*keys).agg(F.max("y_end").alias("h")).select(*keys, F.explode(F.sequence(F.lit(0), (F.col("h") / 1111).cast("int"))).alias("ord"))
    return assign_regions(words.withColumn("avg_y", (F.col("ord") * 1111).cast("double")), regions, keys)


def bbox_union_window(spark: SparkSession, sf: str) -> DataFrame:
    w = leaderboard(spark, sf)
    sizes = w.groupBy("image_id").agg((F.max("bottom_y") + 900 + F.col("image_id").cast("int") * 20).alias("height")).withColumn("width", F.lit(1080))
    return bbox_window(w, sizes)


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/player_entry.parquet")
    return e.select(F.col("entry_id").alias("anchor_ord"), F.coalesce("capture_id", F.lit(0)).alias("image_id"), "category", "player_name", "score")


def category_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """All entries in the order of their captures, numbered within their category."""
    return B.leaderboard(_entries(spark, sf)).select("category", "place", F.col("anchor_ord").alias("entry_id"), "player_name", "score")


def category_totals(spark: SparkSession, sf: str) -> DataFrame:
    return B.totals(_entries(spark, sf))


def category_override(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_category(extract_players(leaderboard(spark, sf)).drop("candidates"), None, "friday")


def batch_response(spark: SparkSession, sf: str) -> DataFrame:
    """The answer for one batch: words are classified, their players extracted and collected by category as JSON."""
    w = leaderboard(spark, sf)
    classified = w.select("image_id").distinct().withColumn("category", F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod("image_id", F.lit(len(CATEGORIES))) + 1).cast("int")))
    return B.response(B.with_category(extract_players(w).drop("candidates"), classified))


QUERIES = {
    "classify_day_text": classify_day_text, "classify_signals": classify_signals, "classify_captures": classify_captures, "hsv_orange": hsv_orange, "brightness_argmax_gap": brightness_argmax_gap, "fixture_category": fixture_category,
    "stitch_bisect": stitch_bisect, "stitch_layout": stitch, "region_assign": region_assign, "bbox_union_window": bbox_union_window,
    "category_leaderboard": category_leaderboard, "category_totals": category_totals, "category_override": category_override, "batch_response": batch_response,
}


def _rules(words: str) -> str:
    """Common table expressions up to ``c``: category, confidence and rule of each image."""
    text = D.strip("text")
    has = lambda *w: " AND ".join(f"list_contains(words, '{x}')" for x in w)
    no_days = " AND ".join(f"NOT list_contains(words, '{s}.')" for s in ("mon", "tues", "wed", "thur", "fri", "sat"))
    order = "CASE day " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday"))) + " END"
    return f"""
wd AS (SELECT image_id, lower({text}) AS t, {D.day('text')} AS day FROM ({words}) AS w),
sets AS (SELECT image_id, list(DISTINCT t) AS words FROM wd GROUP BY image_id),
days AS (SELECT image_id, day, sum(CASE WHEN t IN ('mon', 'tues', 'wed', 'thur', 'fri', 'sat') THEN 2 ELSE 1 END) AS points FROM wd WHERE day IS NOT NULL GROUP BY ALL),
best AS (SELECT image_id, arg_max(day, points * 10 - {order}) AS day FROM days GROUP BY image_id),
c AS (
  SELECT image_id,
    CASE WHEN ({has('strength', 'daily', 'weekly')}) OR ({has('strength', 'ranking')}) THEN 'strength' WHEN {has('alliance', 'contribution')} THEN 'alliance'
      WHEN {has('weekly', 'rank')} AND {no_days} THEN 'weekly' WHEN day IS NOT NULL THEN 'day_by_text' ELSE 'none' END AS rule, day
  FROM sets LEFT JOIN best USING (image_id)),
r AS (
  SELECT image_id, CASE rule WHEN 'strength' THEN 'power' WHEN 'weekly' THEN 'weekly' WHEN 'day_by_text' THEN day END AS category,
    CAST(CASE rule WHEN 'strength' THEN 1.0 WHEN 'weekly' THEN 1.0 WHEN 'day_by_text' THEN 0.75 ELSE 0.0 END AS DOUBLE) AS confidence, rule FROM c)"""


_HSV = f"""
WITH p AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM ({COLOURS}) AS t),
q AS (SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE CAST(CASE WHEN r = hi THEN (g - b) / CAST(hi - lo AS DOUBLE) WHEN g = hi THEN 2 + (b - r) / CAST(hi - lo AS DOUBLE) ELSE 4 + (r - g) / CAST(hi - lo AS DOUBLE) END AS DOUBLE) / 6 END AS h0,
  CASE WHEN hi = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(hi - lo AS DOUBLE) / hi END AS s, hi / CAST(255 AS DOUBLE) AS v FROM p),
h AS (SELECT *, h0 - floor(h0) AS h FROM q)
"""
_FRAME_CTE = f"""
f AS ({FRAMES}),
g AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id, width, height ORDER BY image_seq) - 1 AS INTEGER) AS group_pos FROM f),
n AS (SELECT batch_id, width, height, count(*) AS n FROM f GROUP BY ALL),
cut AS (
  SELECT batch_id, width, height, CAST(0 AS BIGINT) AS lo, n FROM n
  UNION ALL
  SELECT batch_id, width, height, CASE k WHEN 0 THEN lo ELSE lo + n // 2 END, CASE k WHEN 0 THEN n // 2 ELSE n - n // 2 END
  FROM cut, (VALUES (0), (1)) AS v(k) WHERE n > 1 AND (n * height + (n - 1) * 10) * width > 75000000),
leaf AS (SELECT * FROM cut WHERE n = 1 OR (n * height + (n - 1) * 10) * width <= 75000000),
b AS (
  SELECT g.batch_id, g.image_seq, g.width, g.height, g.group_pos, leaf.lo AS sub_batch FROM g JOIN leaf
  ON g.batch_id = leaf.batch_id AND g.width = leaf.width AND g.height = leaf.height AND g.group_pos >= leaf.lo AND g.group_pos < leaf.lo + leaf.n),
lay AS (SELECT *, CAST((group_pos - sub_batch) * (height + 10) AS BIGINT) AS y_start, CAST((group_pos - sub_batch) * (height + 10) + height AS BIGINT) AS y_end FROM b)"""
_KNOWN = ", ".join(repr(c) for c in CATEGORIES)
SQL = {
    "classify_day_text": f"WITH {_rules(DAYS)} SELECT * FROM r",
    "classify_signals": f"WITH {_rules(f'SELECT image_id, unnest(string_split(words, chr(32))) AS text FROM ({SIGNALS}) AS s')} SELECT * FROM r",
    "classify_captures": f"WITH {P.flat()}, {_rules('SELECT image_id, text FROM w')} SELECT * FROM r",
    "hsv_orange": _HSV + "SELECT p_partkey, round(h, 9) AS h, round(s, 9) AS s, round(v, 9) AS v, h BETWEEN 0.014 AND 0.153 AND s >= 0.40 AND v >= 0.55 AS orange FROM h",
    "brightness_argmax_gap": f"""
WITH m AS (SELECT p_brand, concat('t', p_partkey % 7) AS label, max(greatest(r, g, b) / CAST(255 AS DOUBLE)) AS v FROM ({COLOURS}) AS t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, label DESC) AS rn, lead(v) OVER (PARTITION BY p_brand ORDER BY v DESC, label DESC) AS next FROM m)
SELECT p_brand, label FROM k WHERE rn = 1 AND (next IS NULL OR v - next >= 0.004)""",
    "fixture_category": f"""
WITH k AS (SELECT unnest([{_KNOWN}, 'donation']) AS key, unnest([{_KNOWN}, 'donation_daily']) AS category),
n AS (SELECT DISTINCT concat('IMG_', upper(category), '.json') AS name FROM player_entry WHERE category IS NOT NULL)
SELECT name, arg_min(category, 1000000 - length(key)) AS category FROM n JOIN k ON contains(lower(name), key) GROUP BY name""",
    "stitch_bisect": f"WITH RECURSIVE {_FRAME_CTE} SELECT * FROM b",
    "stitch_layout": f"WITH RECURSIVE {_FRAME_CTE} SELECT * FROM lay",
    "region_assign": f"""
WITH RECURSIVE {_FRAME_CTE},
s AS (SELECT batch_id, width, height, sub_batch, max(y_end) AS h FROM lay GROUP BY ALL),
w AS (SELECT *, unnest(range(0, CAST(floor(h / 1111) AS BIGINT) + 1)) AS ord FROM s)
SELECT batch_id, width, height, sub_batch, CAST(ord AS INTEGER) AS ord, CAST(ord * 1111 - y_start AS DOUBLE) AS avg_y, image_seq AS image_id
FROM w JOIN lay USING (batch_id, width, height, sub_batch) WHERE ord * 1111 >= y_start AND ord * 1111 < y_end""",
    "bbox_union_window": f"""
WITH b AS (SELECT image_id, min(left_x) AS l, min(top_y) AS t, max(right_x) AS r, max(bottom_y) AS b, 1080 AS w, CAST(max(bottom_y) + 900 + image_id * 20 AS INTEGER) AS h FROM ({duck_sql(LEADERBOARD)}) AS x GROUP BY image_id),
p AS (SELECT image_id, w, h, greatest(0, l - CAST(trunc(w * 0.02) AS INTEGER)) AS "left", greatest(0, t - CAST(trunc(h * 0.02) AS INTEGER)) AS top,
  least(w, r + CAST(trunc(w * 0.02) AS INTEGER)) AS "right", least(h, b + CAST(trunc(h * 0.02) AS INTEGER)) AS bottom FROM b)
SELECT image_id, "left", top, "right", bottom FROM p WHERE "right" - "left" >= trunc(w * 0.20) AND bottom - top >= trunc(h * 0.20) AND NOT ("right" - "left" = w AND bottom - top = h)""",
    "category_leaderboard": f"""
SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY coalesce(capture_id, 0), entry_id) - 1 AS BIGINT) AS place, entry_id, player_name, score
FROM player_entry WHERE category IN ({_KNOWN})""",
    "category_totals": "SELECT category, count(*) AS players, CAST(sum(score) AS BIGINT) AS score FROM player_entry GROUP BY category",
    "category_override": f"WITH {P.board()} SELECT image_id, anchor_ord, player_name, score, 'friday' AS category FROM p",
    "batch_response": f"""
WITH {P.board()}, c AS (SELECT *, CASE image_id % {len(CATEGORIES)} {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES))} END AS category FROM p)
SELECT category, CAST(to_json(list({{'player_name': player_name, 'score': score}} ORDER BY image_id, anchor_ord)) AS VARCHAR) AS entries FROM c GROUP BY category""",
}
