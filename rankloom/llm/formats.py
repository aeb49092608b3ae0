"""Problem 6: records that are equal but for white space, letter case, punctuation or the order of fields."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ready
from ..functions.text import held
from ..operators.skew import join_to_unique
from ..scratch import keep

FIELDS = ("player_name", "score", "category", "source_file")
#: Bits of a merged filter: about so many for a row, a power of two, within these bounds (64 MB at most, the size that is broadcast).
#: More rows than that are split into ranges of their hashes, each with a filter of its own.
BITS_A_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29
SEGMENT_BITS = 1 << 16
PROBES = 4
#: Filters merged in one group.
FAN_IN = 64
SEPARATOR = "\x1f"


def canonical(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def parse_fields(payload: Column) -> Column:
    """An array of (name, value) in canonical form, from a JSON object or from ``name: value`` or ``name = value``
    parts between semicolons or line ends."""
    text = F.regexp_replace(payload, r"^[\s﻿]+|\s+$", "")
    pairs = F.transform(
        F.map_entries(F.from_json(text, "map<string,string>")),
        lambda e: F.struct(canonical(e["key"]).alias("name"), F.coalesce(canonical(e["value"]), F.lit("")).alias("value")),
    )

    def part(p: Column) -> Column:
        return F.struct(
            canonical(F.regexp_extract(p, r"^([^:=]*)[:=]", 1)).alias("name"),
            canonical(F.regexp_extract(p, r"(?s)^[^:=]*[:=](.*)$", 1)).alias("value"),
        )

    parts = F.transform(F.split(text, r"[;\r\n]"), part)
    return F.when(text.startswith("{"), F.coalesce(pairs, parts)).otherwise(parts)


def keyed(df: DataFrame, payload: str, row_id: str) -> DataFrame:
    """(row_id, key): the four canonical fields of each record in one string.

    Rows whose payload is null or names none of the fields are left out. A field that is missing, null or without letters
    and digits is empty; of a field given twice the first counts. Each payload is parsed once.
    """
    parsed = held(df.select(F.col(f"`{row_id}`").alias(row_id), F.col(f"`{payload}`").alias("payload__")), fields__=parse_fields(F.col("payload__")))
    names = [n.replace("_", "") for n in FIELDS]

    def value(name: str) -> Column:
        return F.coalesce(F.get(F.filter("fields__", lambda f: f["name"] == name), F.lit(0))["value"], F.lit(""))

    named = parsed.filter(F.exists("fields__", lambda f: f["name"].isin(names)))
    return held(named, key=F.concat_ws(SEPARATOR, *map(value, names))).select(row_id, "key")


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash: an array of PROBES rows."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)])


def _set(filled: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filled, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _has(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _segments(part: int, once: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    rows = []
    size = SEGMENT_BITS // 8
    for k in range(len(once) // size):
        a, b = once[k * size : (k + 1) * size], again[k * size : (k + 1) * size]
        if a.any():
            rows.append((part, k, pa.compress(a.tobytes(), "zstd", asbytes=True), pa.compress(b.tobytes(), "zstd", asbytes=True)))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
        names=["part", "segment", "once", "again"],
    )


_SCHEMA = "part int, segment int, once binary, again binary"


def repeat_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter that holds every hash that the one column of ``hashes`` has more than once, and few others.

    Each partition fills a filter of what it has seen and one of what it has seen again; merging two pairs,
    what both have seen was seen again. Filters travel in compressed segments and are merged as a tree.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            own, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            at = _positions(own, bits)
            seen = _has(once, at) | (n > 1)
            _set(again, at[:, seen].ravel())
            _set(once, at.ravel())
        yield _segments(TaskContext.get().partitionId(), once, again)

    def merge(table: pa.Table) -> pa.Table:
        once, again = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
        for a, b in zip(table.column("once").to_pylist(), table.column("again").to_pylist()):
            a, b = (np.frombuffer(pa.decompress(x, SEGMENT_BITS // 8, "zstd", asbytes=True), np.uint8) for x in (a, b))
            again |= b | (once & a)
            once |= a
        t = _segments(0, once, again)
        return pa.table(
            [pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([table.column("segment")[0].as_py()], pa.int32()), t.column(2), t.column(3)],
            names=["part", "segment", "once", "again"],
        )

    parts = hashes.mapInArrow(fill, _SCHEMA)
    for _ in range(2):  # FAN_IN ** 2 partitions, then whatever is left in one group
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("segment", "part").applyInArrow(merge, _SCHEMA)
    parts = parts.withColumn("part", F.lit(0)).groupBy("segment", "part").applyInArrow(merge, _SCHEMA)
    out = np.zeros(bits // 8, np.uint8)
    size = SEGMENT_BITS // 8
    for row in parts.select("segment", "again").toLocalIterator():  # no more than MOST_BITS in all
        out[row.segment * size : (row.segment + 1) * size] = np.frombuffer(pa.decompress(bytes(row.again), size, "zstd", asbytes=True), np.uint8)
    return out


def filter_bits(rows: int) -> tuple[int, int]:
    """(bits of a filter, number of ranges of hashes), so that a filter has about BITS_A_ROW bits for each row, however many there are."""
    bits, ranges = LEAST_BITS, 1
    while bits * ranges < rows * BITS_A_ROW:
        bits, ranges = (bits * 2, 1) if bits < MOST_BITS else (bits, ranges * 2)
    return bits, ranges


def split_repeats(df: DataFrame, payload: str = "payload", row_id: str = "raw_id") -> tuple[DataFrame, DataFrame, int]:
    """(possible repeats, records surely met once, number of rows): both with the id and the record's ``key``.

    Payloads are parsed once: ids, keys and hashes are kept in the shared folder, by range of the hash, and each range is
    marked with its own filter. The possible repeats have every true one among them; the others are never shuffled.
    """
    spark = df.sparkSession
    ready(spark)
    total = df.count()
    bits, ranges = filter_bits(total)
    hashed = keyed(df, payload, row_id).withColumn("hash", F.xxhash64("key"))
    hashed = hashed.withColumn("span", F.shiftrightunsigned("hash", 65 - ranges.bit_length()).cast("int") if ranges > 1 else F.lit(0))
    hashed = keep(hashed, "keys", by="span")
    parts = []
    for r in range(ranges):
        own = hashed.filter(F.col("span") == r)
        parts.append(_marked(own, spark.sparkContext.broadcast(repeat_filter(own.select("hash"), bits)), bits).select(row_id, "key", "maybe"))
        if ranges > 1:  # written range by range, so that one filter at a time is held
            parts[-1] = keep(parts[-1], "marked")
    marked = reduce(DataFrame.unionByName, parts)
    return keep(marked.filter("maybe").drop("maybe"), "repeats"), marked.filter("not maybe").drop("maybe"), total


def _marked(hashed: DataFrame, again: Broadcast, bits: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(_has(again.value, _positions(h.to_numpy(), bits)))

    return hashed.withColumn("maybe", maybe("hash"))


def collapse(df: DataFrame, payload: str = "payload", row_id: str = "raw_id") -> DataFrame:
    """One row for each record: its smallest id, its four canonical fields and the number of its copies.

    Null payloads and payloads that name none of the fields are no records. Rows without an id count as copies.
    A payload that is not readable as JSON is read as name/value parts.
    """
    repeats, once, _ = split_repeats(df, payload, row_id)
    groups = repeats.groupBy("key").agg(F.min(row_id).alias(row_id), F.count("*").alias("n_copies"))
    every = groups.unionByName(once.withColumn("n_copies", F.lit(1).cast("bigint")))
    fields = F.split("key", SEPARATOR, -1)
    return every.select(row_id, *[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(FIELDS)], "n_copies")


def copies(df: DataFrame, payload: str = "payload", row_id: str = "raw_id") -> DataFrame:
    """(raw_id_a, raw_id_b): the smallest id of a record and each of its other copies; rows without an id have no pair."""
    repeats, _, total = split_repeats(df, payload, row_id)
    repeats = repeats.filter(F.col(row_id).isNotNull())
    groups = repeats.groupBy("key").agg(F.min(row_id).alias("raw_id_a"), F.count("*").alias("n")).filter("n > 1")
    pairs = join_to_unique(repeats.withColumnRenamed(row_id, "raw_id_b"), groups, "key", "n", total)
    return pairs.filter("raw_id_b > raw_id_a").select("raw_id_a", "raw_id_b")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf}/raw_entry.parquet"))


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf}/raw_entry.parquet"))


def _field(name: str) -> str:
    squeeze = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    return (
        f"coalesce(CASE WHEN t LIKE '{{%' THEN {squeeze.format(f"json_extract_string(t, '$.{name}')")} "
        f"ELSE {squeeze.format(f"regexp_extract(t, '(?i)(?:^|[;\\r\\n])\\s*{name}\\s*[:=]([^;\\r\\n]*)', 1)")} END, '') AS {name}"
    )


_NAMED = " OR ".join(
    [*(f"(t LIKE '{{%' AND json_exists(t, '$.{n}'))" for n in FIELDS), *(f"(t NOT LIKE '{{%' AND regexp_matches(t, '(?i)(?:^|[;\\r\\n])\\s*{n}\\s*[:=]'))" for n in FIELDS)]
)
_RECORDS = f"""
WITH t AS (SELECT raw_id, regexp_replace(payload, '^\\s+|\\s+$', '', 'g') AS t FROM raw_entry WHERE payload IS NOT NULL),
r AS (SELECT raw_id, {', '.join(map(_field, FIELDS))} FROM t WHERE {_NAMED}),
g AS (SELECT {', '.join(FIELDS)}, min(raw_id) AS raw_id_a, count(*) AS n_copies FROM r GROUP BY ALL)
"""
QUERIES = {"p6_found": p6_found, "p6_records": p6_records}
SQL = {
    "p6_found": _RECORDS + f"SELECT raw_id_a, raw_id AS raw_id_b FROM r JOIN g USING ({', '.join(FIELDS)}) WHERE raw_id > raw_id_a",
    "p6_records": _RECORDS + f"SELECT raw_id_a AS raw_id, {', '.join(FIELDS)}, n_copies FROM g",
}
