"""Problem 8: a mix of sources with target weights, in blocks of tokens.

The tokens of each source are packed into blocks of fixed length. Every output shard draws how many of its slots each
source gets from a multinomial distribution; a slot's place among all draws of its source goes through a pseudorandom
permutation of the source's blocks, and blocks are joined by their index. A source is drawn exactly as often as its
share says, and no block, so no document, more often than allowed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arrow import ready
from ..operators.skew import broadcast_if_small
from ..scratch import keep
from .tokens import vocabulary

#: Tokens of a block, slots of a shard, shards drawn by one row of the plan.
BLOCK, SLOTS, CHUNK = 256, 1024, 256
#: Sources that may have a target, at most.
MOST_SOURCES = 10_000
SEED = 20240511


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, or the way back: four Feistel rounds, walked until the value is below n."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)) for r in range(4)]

    def mix(v: np.ndarray, k: np.uint64) -> np.ndarray:
        v = (v ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (v ^ (v >> np.uint64(32))) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ mix(left, k), left
            else:
                left, right = right, left ^ mix(right, k)
        return (left << half) | right

    out = once(np.asarray(x, np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass
class Plan:
    """How often each source is drawn. Arrays run over the sources that have tokens and a share."""

    names: list[str]
    tokens: np.ndarray
    blocks: np.ndarray
    shares: np.ndarray
    quotas: np.ndarray
    block: int

    @property
    def slots(self) -> int:
        return int(self.quotas.sum())

    @property
    def shards(self) -> int:
        return -(-self.slots // SLOTS)

    def size(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Tokens of a block: the last of a source may be short."""
        return np.where(block == self.blocks[source] - 1, self.tokens[source] - (self.blocks[source] - 1) * self.block, self.block)

    def draws(self, shard: int) -> np.ndarray:
        """How many slots of a shard each source gets."""
        n = min(SLOTS, self.slots - shard * SLOTS)
        return np.random.Generator(np.random.Philox(key=SEED, counter=[shard, 0, 0, 0])).multinomial(n, self.shares)


def make_plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], block: int = BLOCK, total: int | None = None) -> Plan:
    """The largest mix in which every source that has tokens reaches its share under its cap, or one of ``total`` tokens.

    Shares of sources without tokens are spread over the others in proportion. A larger ``total`` than the caps allow is cut.
    """
    names = sorted(s for s, (share, most) in targets.items() if share > 0 and most > 0 and tokens.get(s, 0) > 0)
    have = np.array([tokens[s] for s in names], np.int64)
    blocks = -(-have // block)
    shares = np.array([targets[s][0] for s in names])
    shares = shares / shares.sum() if len(names) else shares
    caps = blocks * np.array([targets[s][1] for s in names], np.int64) if names else blocks
    slots = float((caps / shares).min()) if len(names) else 0.0
    if total is not None:
        slots = min(slots, total / block)
    quotas = np.minimum(np.floor(slots * shares + 1e-9).astype(np.int64), caps) if len(names) else caps
    return Plan(names, have, blocks, shares, quotas, block)


def measured(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(source, file, part, start, n, ids) of each document of a source with a target, kept in the shared folder: its ids, and the
    place of the first one among the tokens of its source in the same part of a file.

    Documents have the order of their files and of their rows within them, which are read where they lie, so the mix doesn't
    depend on how files are split or on the cluster. Tables that aren't read from files have the order of their partitions.
    """
    spark = documents.sparkSession
    ready(spark)
    shared = vocabulary(spark, path)
    listed = broadcast_if_small(targets.select("source").filter("source is not null").distinct(), MOST_SOURCES)
    columns = ["source", F.col("text").cast("string").alias("text")]
    try:
        given = documents.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    except AnalysisException:  # not read from files
        given = documents.select(*columns, F.lit("").alias("file"), F.spark_partition_id().cast("bigint").alias("part"))
    given = given.filter("text <> ''").join(listed, "source", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict = defaultdict(int)
        for batch in batches:
            ids, n = shared.value.encode(batch.column(1).to_pylist())
            starts = []
            for *at, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), n.tolist()):
                starts.append(used[tuple(at)])
                used[tuple(at)] += k
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(starts, pa.int64()), pa.array(n), lists], names=["source", "file", "part", "start", "n", "ids"]
            )

    return keep(given.select("source", "text", "file", "part").mapInArrow(run, "source string, file string, part bigint, start bigint, n bigint, ids array<int>"), "tokens")


def prepare(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str | None = None) -> tuple[DataFrame, Plan]:
    rows = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    tokens = measured(documents, targets, path)
    sums = {r.source: r.n for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # no more rows than targets
    return tokens, make_plan(sums, {r.source: (r.share or 0.0, r.most or 0) for r in rows}, total=total)


def slots_of(spark: SparkSession, plan: Plan) -> DataFrame:
    """(shard, slot, source, draw, block, copy, n_tokens) of every slot of the mix."""
    schema = "shard bigint, slot int, source string, draw bigint, block bigint, copy int, n_tokens bigint"
    if plan.slots == 0:
        return spark.createDataFrame([], schema)
    ready(spark)
    shared = spark.sparkContext.broadcast(plan)
    rows = -(-plan.shards // CHUNK)
    chunks = spark.range(0, rows, 1, min(rows, 2 * spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "chunk")

    def of(plan: Plan, chunk: int) -> range:
        return range(chunk * CHUNK, min(plan.shards, (chunk + 1) * CHUNK))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for c in batch.column(0).to_pylist():
                n = sum(p.draws(h) for h in of(p, c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["chunk", "s", "n"])

    totals = keep(chunks.mapInArrow(count, "chunk bigint, s int, n bigint"), "draws")
    drawn = np.zeros(len(plan.names), np.int64)
    for r in totals.groupBy("s").agg(F.sum("n").alias("n")).collect():
        drawn[r.s] = r.n
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = totals.withColumn("before", earlier).groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "before"))), lambda x: x["before"]).alias("before"))
    # draws beyond a source's quota go to those that were drawn too seldom, one for one
    over, under = np.maximum(drawn - plan.quotas, 0), np.maximum(plan.quotas - drawn, 0)
    over_from, under_to = np.cumsum(over) - over, np.cumsum(under)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        names = np.array(p.names, object)
        for batch in batches:
            for c, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.array(before, np.int64)
                for h in of(p, c):
                    n = p.draws(h)
                    s = np.repeat(np.arange(len(n)), n)
                    j = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + at[s]
                    at = at + n
                    late = np.flatnonzero(j >= p.quotas[s])
                    if len(late):
                        rank = over_from[s[late]] + j[late] - p.quotas[s[late]]
                        s[late] = np.searchsorted(under_to, rank, side="right")
                        j[late] = drawn[s[late]] + rank - (under_to - under)[s[late]]
                    block = np.empty(len(s), np.int64)
                    for k in np.unique(s):
                        m = s == k
                        block[m] = permute(j[m] % p.blocks[k], int(p.blocks[k]), SEED + int(k))
                    place = np.random.Generator(np.random.Philox(key=SEED + 1, counter=[h, 0, 0, 0])).permutation(len(s)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), h)), pa.array(place), pa.array(names[s], pa.string()), pa.array(j), pa.array(block), pa.array((j // p.blocks[s]).astype(np.int32)), pa.array(p.size(s, block))],
                        names=[f.split()[0] for f in schema.split(", ")],
                    )

    return begins.mapInArrow(fill, schema)


def blocks_of(tokens: DataFrame, plan: Plan) -> DataFrame:
    """(source, block, ids) of every block that the mix uses; others aren't shuffled."""
    spark = tokens.sparkSession
    parts = tokens.groupBy("source", "file", "part").agg(F.sum("n").alias("part_n"))
    before = F.coalesce(F.sum("part_n").over(Window.partitionBy("source").orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = broadcast_if_small(parts.select("source", "file", "part", before.alias("offset")))
    placed = tokens.filter("n > 0").join(offsets, ["source", "file", "part"]).withColumn("at", F.col("offset") + F.col("start"))
    size = plan.block
    spans = F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + n - 1) div {size}"))

    def piece(b):
        skip = F.greatest(b * size - F.col("at"), F.lit(0))
        long = F.least((b + 1) * size - F.col("at"), F.col("n")) - skip
        return F.struct(b.alias("block"), (F.col("at") + skip).alias("from"), F.slice("ids", (skip + 1).cast("int"), long.cast("int")).alias("ids"))

    pieces = placed.select("source", F.inline(F.transform(spans, piece)))
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("boolean")
    def used(source: pd.Series, block: pd.Series) -> pd.Series:
        p = shared.value
        out = np.zeros(len(source), bool)
        at = source.map({s: k for k, s in enumerate(p.names)}).fillna(-1).to_numpy(np.int64)
        for k in np.unique(at[at >= 0]):
            m = at == k
            out[m] = permute(block.to_numpy(np.int64)[m], int(p.blocks[k]), SEED + int(k), back=True) < p.quotas[k]
        return pd.Series(out)

    own = pieces.filter(used("source", "block"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", "ids"))), lambda x: x["ids"]))
    return own.groupBy("source", "block").agg(joined.alias("ids"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(shard, slot, source, draw, block, copy, n_tokens, ids): the mix, one row for each slot.

    Documents of null or unlisted sources, and null and empty texts, aren't used. ``copy`` counts from 0 how often the
    block was used before. The mix is as large as the scarcest source allows with every share reached, or ``total`` tokens.
    """
    tokens, plan = prepare(documents, targets, total)
    # the planner takes the slots for a few rows, as they come from a function over few rows; both sides grow with the mix
    return slots_of(documents.sparkSession, plan).hint("merge").join(blocks_of(tokens, plan), ["source", "block"])


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row for each source of either table: the share aimed at and the one reached, in tokens of the mix.

    Sources without a target have a target of 0; a null source is reported as such. A source without documents reaches 0.
    """
    spark = documents.sparkSession
    _, plan = prepare(documents, targets, total)
    slots = slots_of(spark, plan)
    reached = slots.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("slots"), (F.max("copy") + 1).alias("repeats"))
    have = spark.createDataFrame([(s, int(n), int(b)) for s, n, b in zip(plan.names, plan.tokens, plan.blocks)], "source string, source_tokens bigint, source_blocks bigint")
    given = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = documents.groupBy("source").agg(F.count("*").alias("documents")).join(given.withColumnRenamed("source", "listed"), F.col("source").eqNullSafe(F.col("listed")), "full")
    every = every.withColumn("source", F.coalesce("source", "listed")).drop("listed").join(have, "source", "left").join(reached, "source", "left")
    all_ = F.sum("tokens").over(Window.partitionBy())
    none = ("documents", "source_tokens", "source_blocks", "tokens", "slots", "repeats")
    return every.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce(F.round(F.col("tokens") / all_, 6), F.lit(0.0)).alias("share"), "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in none]
    )


def _tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "source_target")]


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(*_tables(spark, sf))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(*_tables(spark, sf))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
