"""Words made from the tables of test data, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEADERBOARD = """
WITH spend AS (
  SELECT c_nationkey AS image_id, c_custkey, CAST(SUM(CAST(ROUND(o_totalprice*100) AS BIGINT)) AS BIGINT) AS score
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey),
ranked AS (
  SELECT image_id, c_custkey, score, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, c_custkey) AS INT) AS rk FROM spend),
lines AS (
  SELECT image_id, rk, CAST(400 + 80*(rk-1) AS DOUBLE) AS y, {fmt} AS score_txt,
         CASE WHEN rk % 5 = 0 THEN 'Iron' ELSE '' END AS name1,
         CONCAT(CASE WHEN rk % 5 = 0 THEN 'Wolf' ELSE 'Player' END, CAST(c_custkey AS {string})) AS name2,
         (rk % 7 = 3) AS crash, (rk % 14 = 3) AS crash_norank FROM ranked),
toks AS (
  SELECT image_id, rk, 1 AS k, 60.0 AS x, y, CAST(rk AS {string}) AS text FROM lines WHERE NOT crash_norank
  UNION ALL SELECT image_id, rk, 2, 130.0, y, CONCAT('R', CAST(1 + rk % 5 AS {string})) FROM lines
  UNION ALL SELECT image_id, rk, 3, 200.0, y, '[TaG]' FROM lines
  UNION ALL SELECT image_id, rk, 4, 270.0, y, name1 FROM lines WHERE name1 <> ''
  UNION ALL SELECT image_id, rk, 5, 340.0, y, CASE WHEN crash THEN CONCAT(name2, score_txt) ELSE name2 END FROM lines
  UNION ALL SELECT image_id, rk, 6, 600.0, y + 3, score_txt FROM lines WHERE NOT crash
  UNION ALL SELECT image_id, rk, 7, 340.0, y + 30, 'Pantheon' FROM lines)
SELECT CAST(image_id AS BIGINT) AS image_id, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY y, x, k) AS INT) AS ord,
       text, CAST(x AS DOUBLE) AS avg_x, CAST(y AS DOUBLE) AS avg_y,
       CAST(x AS INT) - 20 AS left_x, CAST(x AS INT) + 20 AS right_x, CAST(y AS INT) - 20 AS top_y, CAST(y AS INT) + 20 AS bottom_y
FROM toks
"""
DAYS = """
SELECT user_id AS image_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ord,
       CONCAT(CASE event_id % 6 WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tues' WHEN 2 THEN 'Wed' WHEN 3 THEN 'Thur' WHEN 4 THEN 'Fri' ELSE 'Sat' END,
              CASE WHEN event_id % 4 = 0 THEN '' ELSE '.' END) AS text
FROM events
"""
SIGNALS = """
SELECT c_custkey AS image_id, CASE c_custkey % 5
  WHEN 0 THEN 'RANKING Daily Rank Weekly Rank Ranking Commander Points'
  WHEN 1 THEN 'STRENGTH RANKING Power Kills Donation Ranking Commander Power'
  WHEN 2 THEN 'STRENGTH RANKING Power Kills Donation Daily Weekly Ranking Commander Points'
  WHEN 3 THEN 'ALLIANCE CONTRIBUTION RANKING Siege Defeat Daily Weekly Season Total Ranking'
  ELSE 'Hello World' END AS words
FROM customer
"""
FRAMES = """
SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS batch_id, o_orderkey % 100 AS image_seq,
       CASE WHEN o_orderkey % 3 = 0 THEN 1080 ELSE 1440 END AS width, CASE WHEN o_orderkey % 3 = 1 THEN 2400 ELSE 3120 END AS height
FROM orders
"""
COLOURS = """
SELECT p_partkey, p_brand, CAST(p_size*5 % 256 AS INT) AS r, CAST(p_partkey % 256 AS INT) AS g, CAST((p_partkey*7) % 256 AS INT) AS b FROM part
"""
RAW_NAMES = """
SELECT c_custkey AS id, CASE c_custkey % 12
  WHEN 0 THEN CONCAT('1. ', nm) WHEN 1 THEN CONCAT('48 R4 [ZaPp]', nm) WHEN 2 THEN CONCAT(nm, ' [TAG]') WHEN 3 THEN CONCAT('(Tag) ', nm, ' ZaPp')
  WHEN 4 THEN CONCAT(nm, '  pantheon of WRATH') WHEN 5 THEN CONCAT('R2 ', nm, '!?*') WHEN 6 THEN CONCAT('  ', nm, '   x ') WHEN 7 THEN CONCAT('100', nm)
  WHEN 8 THEN '12 CoRe' WHEN 9 THEN CONCAT('ก', nm, 'ฟ') WHEN 10 THEN CONCAT('Pà ', nm, '_é-') ELSE nm END AS raw
FROM (SELECT c_custkey, replace(c_name, '#', ' ') AS nm FROM customer) AS named
"""


def duck(sql: str) -> str:
    return sql.format(fmt="format('{:,}', score)", string="VARCHAR") if "{fmt}" in sql else sql


def spark_sql(sql: str) -> str:
    return sql.format(fmt="format_number(score, 0)", string="STRING") if "{fmt}" in sql else sql


def load(spark: SparkSession, sf: str, sql: str, *tables: str) -> DataFrame:
    """The result of ``sql`` over tables of a folder, bound to their files and not to names in the session."""
    for t in sorted(tables, key=len, reverse=True):
        sql = spark_sql(sql).replace(f" {t} ", f" {{{t}}} ").replace(f" {t}\n", f" {{{t}}}\n").replace(f" {t})", f" {{{t}}})")
    return spark.sql(sql.strip(), **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in tables})


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, spark_sql(LEADERBOARD), "orders", "customer")
