"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows; there can be no more hot keys than its inverse, so they are broadcast.
HOT_SHARE = 0.001


def hot_keys(counts: DataFrame, n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """The rows of a table of counts by key that hold at least ``share`` of ``total``: at most 1/share rows."""
    return counts.filter(F.col(n) >= max(2, int(total * share)))


def join_to_unique(rows: DataFrame, unique: DataFrame, key: str, n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of many rows with a table that has each key once and its number of rows in ``n``.

    Rows of hot keys meet a broadcast of at most 1/share keys where they are; only the others are shuffled,
    and none of those keys has more than that share of the rows.
    """
    limit = max(2, int(total * share))
    hot = F.broadcast(unique.filter(F.col(n) >= limit))
    cold = unique.filter(F.col(n) < limit)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


#: Rows, and bytes of them as text, up to which a reference table is broadcast; a larger one is shuffled.
REFERENCE_ROWS, REFERENCE_BYTES = 100_000, 64 << 20


def is_small(df: DataFrame, most: int = REFERENCE_ROWS, bytes_: int = REFERENCE_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows and ``bytes_`` bytes of text, found by one pass over no more rows than that."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    found = df.limit(most + 1).agg(F.count("*").alias("n"), size.alias("size")).first()
    return found.n <= most and (found["size"] or 0) <= bytes_


def broadcast_if_small(df: DataFrame, most: int = REFERENCE_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes, once counted, are few."""
    return F.broadcast(df) if is_small(df, most) else df
