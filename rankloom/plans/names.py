"""Queries on single functions: names, scores, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import duck as D
from .inputs import LEADERBOARD, RAW_NAMES, leaderboard, load
from .inputs import duck as duck_sql

_STEPS = {
    "strip_alliance_tag": (T.strip_alliance_tag, D.alliance_tag),
    "strip_leading_rank": (T.strip_leading_rank, D.leading_rank),
    "strip_rank_badge": (T.strip_rank_badge, D.rank_badge),
    "strip_ocr_noise": (T.strip_noise, D.noise),
    "collapse_whitespace": (T.collapse_spaces, D.spaces),
    "strip_thai": (T.strip_thai, D.thai),
    "strip_bare_tags": (T.strip_bare_tags, D.bare_tags),
    "strip_alliance_suffixes": (T.strip_alliance_suffixes, D.suffixes),
}


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, RAW_NAMES, "customer")


def _step(f):
    return lambda spark, sf: _names(spark, sf).select("id", f(F.col("raw")).alias("name"))


def clean_player_name(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("id", T.clean_player_name(F.col("raw")).alias("name"))


def clean_entry_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all entries, cleaned."""
    return spark.read.parquet(f"{sf}/player_entry.parquet").select("entry_id", T.clean_player_name(F.col("player_name")).alias("name"))


def tag_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = _names(spark, sf).select("id", F.posexplode(T.tokens(F.col("raw"))).alias("pos", "token"))
    return words.select("id", "pos", "token", T.looks_like_tag(F.col("token")).alias("tag"))


def parse_score(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    raw = F.expr(
        "case o_orderkey % 6 when 0 then format_number(o_orderkey * 1000 + 7, 0) when 1 then concat('1O', o_orderkey, 'l') when 2 then concat(o_orderkey, '.5') "
        "when 3 then concat(' ', o_orderkey, ' ') when 4 then concat('I', o_orderkey, ',000') else concat('Points', o_orderkey) end"
    )
    o = o.select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", T.parse_score(F.col("raw")).alias("score"), T.is_numeric_token(F.col("raw")).alias("numeric"))


def crash_split(spark: SparkSession, sf: str) -> DataFrame:
    w = leaderboard(spark, sf).select("image_id", "ord", T.crash_split(F.col("text")).alias("s"))
    return w.filter("s is not null").select("image_id", "ord", F.col("s.name").alias("name"), F.col("s.score").alias("score"))


def crash_all_splits(spark: SparkSession, sf: str) -> DataFrame:
    w = leaderboard(spark, sf).select("image_id", "ord", F.posexplode(T.crash_splits(F.col("text"))).alias("pos", "s"))
    return w.select("image_id", "ord", "pos", F.col("s.name").alias("name"), F.col("s.score_text").alias("score_text"), F.col("s.score").alias("score"))


def day_label(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/player_entry.parquet")
    return e.select("entry_id", T.day_of_label(F.col("category")).alias("day"))


def ui_label(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/player_entry.parquet").select("entry_id", T.is_ui_label(F.col("player_name")).alias("label"))


def valid_players(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/player_entry.parquet")
    return e.filter(T.is_player_row(F.col("player_name"), F.col("score"), 1000)).select("entry_id", T.strip(F.col("player_name")).alias("name"), "score")


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null")
    return d.select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def result_cache_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each content, with the first document that has it: what a cache by content would compute."""
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null")
    return d.groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


QUERIES = {f"clean_names_{k}": _step(f) for k, (f, _) in _STEPS.items()} | {
    "clean_player_name": clean_player_name, "clean_entry_names": clean_entry_names, "tag_tokens": tag_tokens, "parse_score": parse_score, "crash_split": crash_split,
    "crash_all_splits": crash_all_splits, "day_label": day_label, "ui_label": ui_label, "valid_players": valid_players, "content_hash": content_hash,
    "result_cache_dedup": result_cache_dedup,
}

_WORDS = duck_sql(LEADERBOARD)
SQL = {f"clean_names_{k}": f"SELECT id, {g('raw')} AS name FROM ({RAW_NAMES}) AS t" for k, (_, g) in _STEPS.items()} | {
    "clean_player_name": f"WITH t AS ({RAW_NAMES}),\n{D.clean('t', 'raw', 'c')}\nSELECT id, nm AS name FROM c",
    "clean_entry_names": f"WITH t AS (SELECT entry_id, player_name AS raw FROM player_entry),\n{D.clean('t', 'raw', 'c')}\nSELECT entry_id, nm AS name FROM c",
    "tag_tokens": f"""
WITH t AS (SELECT id, list_filter(regexp_split_to_array(raw, '{D.WS}+'), lambda x: x <> '') AS w FROM ({RAW_NAMES}) AS r),
u AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM t)
SELECT id, CAST(pos AS INTEGER) AS pos, token, {D.tag_like('token')} AS tag FROM u""",
    "parse_score": f"""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN format('{{:,}}', o_orderkey * 1000 + 7) WHEN 1 THEN concat('1O', o_orderkey, 'l') WHEN 2 THEN concat(o_orderkey, '.5')
  WHEN 3 THEN concat(' ', o_orderkey, ' ') WHEN 4 THEN concat('I', o_orderkey, ',000') ELSE concat('Points', o_orderkey) END AS raw FROM orders)
SELECT o_orderkey, {D.score('raw')} AS score, {D.numeric('raw')} AS numeric FROM t""",
    "crash_split": f"""
WITH s AS (SELECT image_id, ord, ({D.splits('text')})[1] AS s FROM ({_WORDS}) AS w)
SELECT image_id, ord, s.name AS name, s.score AS score FROM s WHERE s IS NOT NULL""",
    "crash_all_splits": f"""
WITH s AS (SELECT image_id, ord, {D.splits('text')} AS l FROM ({_WORDS}) AS w),
u AS (SELECT image_id, ord, unnest(range(len(l))) AS pos, unnest(l) AS s FROM s)
SELECT image_id, ord, CAST(pos AS INTEGER) AS pos, s.name AS name, s.score_text AS score_text, s.score AS score FROM u""",
    "day_label": f"SELECT entry_id, {D.day('category')} AS day FROM player_entry",
    "ui_label": f"SELECT entry_id, {D.ui_label('player_name')} AS label FROM player_entry",
    "valid_players": f"""
SELECT entry_id, {D.strip('player_name')} AS name, score FROM player_entry
WHERE {D.strip('player_name')} <> '' AND score >= 1000 AND NOT {D.ui_label('player_name')}""",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL",
    "result_cache_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
}
