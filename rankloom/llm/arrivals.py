"""Problem 1: new batches against all accepted history, by sorted neighbourhoods over several keys.

Every accepted capture has one row for each of its keys: its digest, and five interleaved parts of its
fingerprint, of which two fingerprints that differ in at most four bits share at least one. The rows lie in
runs sorted by key, cut into key ranges in the shared folder. A batch reads only the ranges in which its own keys
lie, with the keys' bounds pushed down to the scan, meets the windows of equal keys there, and is then added as a run;
when there are more than RUNS runs of a level, they are merged into one of the next, so a row is rewritten no
more often than there are levels. A window that would hold too many fingerprints is narrowed by keys of the remaining
bits, found the same way, so no pair is lost and no window grows with the history.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ready
from ..scratch import drop, keep, new_path

#: Bits that near fingerprints may differ in. One key more is needed.
MOST_BITS = 4
KEYS = MOST_BITS + 1
DIGEST = KEYS  # the key's number of the digest
#: Fingerprints in a window before it is narrowed, and how often it may be narrowed.
WINDOW, DEPTH = 256, 3
#: Rows of a key range of a run, about, the most bits that choose a range, and the most bounds pushed down to a scan.
SPAN_ROWS, SPAN_BITS, PUSHED = 1 << 16, 15, 64
#: Runs of a level before they are compacted.
RUNS = 4
#: Share of the open captures that a round of thinning must settle to be followed by another.
THINNED = 0.1
#: Open captures and links among them up to which one task settles the rest.
SETTLED, SETTLED_LINKS = 20_000, 200_000
#: Slices in which p1_found lets a table arrive: more than RUNS, so that runs are compacted and read again.
SLICES = 6


def digest(text: Column) -> Column:
    """64 hex digits in lower case, without prefix, separators and white space; null if that isn't what is there."""
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s:\-_]+", ""), r"^(0x|(urn)?sha2?256=?|sha2=?)", "")
    return F.when(squeezed.rlike("^[0-9a-f]{64}$"), squeezed)


def fingerprint(text: Column) -> Column:
    """(high, low): the two halves of 128 bits given as 32 hex digits; null if that isn't what is there."""
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s:\-_]+", ""), r"^0x", "")
    half = lambda at: F.conv(F.substring(squeezed, at, 16), 16, -10).cast("bigint")
    return F.when(squeezed.rlike("^[0-9a-f]{32}$"), F.struct(half(1).alias("high"), half(17).alias("low")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(places: list[int]) -> tuple[int, int]:
    m = sum(1 << p for p in places)
    return _signed(m >> 64), _signed(m & ((1 << 64) - 1))


def _parts(free: list[int]) -> list[list[int]]:
    """The places of each part: every fifth of those still free, so that a shared half never fills a part."""
    return [free[k::KEYS] for k in range(KEYS)]


def _paths(depth: int) -> list[tuple[list[int], list[int]]]:
    """(places of the last part, places still free) of each way to choose a part of what is free ``depth`` times."""
    if depth == 0:
        return [([], list(range(128)))]
    out = []
    for _, free in _paths(depth - 1):
        for part in _parts(free):
            taken = set(part)
            out.append((part, [p for p in free if p not in taken]))
    return out


def _numbered(number: int, hashed: Column) -> Column:
    """A stored key: its number in front of 60 bits of a hash, so that one sorted column serves all numbers."""
    return F.lit(number << 60).bitwiseOR(F.shiftrightunsigned(hashed, 4))


def _part_keys(depth: int) -> Column:
    """An array of (number, key): the parts below path ``number``, each with the key of the window around it."""
    masks = [_masks(part) for part, _ in _paths(depth)]
    high, low = F.array(*[F.lit(m[0]) for m in masks]), F.array(*[F.lit(m[1]) for m in masks])
    out = []
    for k in range(KEYS):
        path = (F.col("number") * KEYS + k) if depth > 1 else F.lit(k)
        above = [F.col("key")] if depth > 1 else []
        hashed = F.xxhash64(*above, path, F.col("high").bitwiseAND(F.get(high, path)), F.col("low").bitwiseAND(F.get(low, path)))
        key = hashed if above else _numbered(k, hashed)
        out.append(F.struct(path.cast("int").alias("number"), key.alias("key")))
    return F.array(*out)


def first_keys() -> Column:
    """An array of (number, key) for the digest and the parts of the fingerprint, as far as they are there."""
    own = F.when(F.col("digest").isNotNull(), F.array(F.struct(F.lit(DIGEST).alias("number"), _numbered(DIGEST, F.xxhash64("digest")).alias("key"))))
    none = F.array().cast("array<struct<number:int,key:bigint>>")
    return F.concat(F.when(F.col("high").isNotNull(), _part_keys(1)).otherwise(none), F.coalesce(own, none))


def _near(a: str, b: str) -> Column:
    bits = F.bit_count(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high"))) + F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low")))
    return bits <= MOST_BITS


def near_pairs(new: DataFrame, old: DataFrame, *more: str, narrow: bool = True) -> DataFrame:
    """(node, other, and ``more`` columns of ``old``): near pairs of a new fingerprint and any one in the same window; both have
    fp, high, low, number, key.

    Windows of more than WINDOW fingerprints are narrowed by parts of the bits that their key leaves open.
    Pairs found in several windows come several times. ``narrow`` is false where no window is known to be so wide.
    """
    out = None

    def within(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.alias("a").join(b.alias("b"), ["number", "key"]).filter(_near("a", "b"))
        return both.select(F.col("a.fp").alias("node"), F.col("b.fp").alias("other"), *[F.col(f"b.{c}") for c in more])

    for depth in range(1, DEPTH + 1):
        wide = None
        if narrow and depth < DEPTH:
            sizes = old.groupBy("number", "key").agg(F.count("*").alias("n")).filter(F.col("n") > WINDOW).drop("n")
            if not sizes.isEmpty():
                wide = keep(sizes.join(new.select("number", "key").distinct(), ["number", "key"], "left_semi"), "wide")
        if wide is None:
            found = within(new, old)
            return found if out is None else out.unionByName(found)
        found = within(new.join(wide, ["number", "key"], "left_anti"), old.join(wide, ["number", "key"], "left_anti"))
        out = found if out is None else out.unionByName(found)

        def deeper(d: DataFrame, *c: str) -> DataFrame:
            return keep(d.join(wide, ["number", "key"], "left_semi").select("fp", "high", "low", *c, F.inline(_part_keys(depth + 1))), "narrow")  # noqa: B023

        new, old = deeper(new), deeper(old, *more)
    return out


@dataclass(frozen=True)
class Run:
    """A sorted run: its folder, the bits of a key that choose its range, and how often its rows have been merged."""

    path: str
    bits: int
    level: int


def _either(conditions: list[Column]) -> Column:
    """A balanced tree of alternatives."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _either(conditions[:half]) | _either(conditions[half:])


class History:
    """All accepted captures, as sorted runs of keys in the shared folder."""

    SCHEMA = "key bigint, id bigint, digest string, high bigint, low bigint, span int"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = new_path(spark, "history")
        self.runs: list[Run] = []
        self.made = 0

    def _write(self, rows: DataFrame, n: int, level: int) -> Run:
        """A run of about ``n`` rows: as many ranges, and tasks, as these rows fill."""
        bits = min(SPAN_BITS, max(0, math.ceil(math.log2(max(1, n) / SPAN_ROWS))))
        run = Run(f"{self.folder}/run-{self.made:06d}", bits, level)
        self.made += 1
        spanned = rows.withColumn("span", F.shiftrightunsigned("key", 63 - bits).cast("int") if bits else F.lit(0))
        spanned.repartition(1 << bits, "span").sortWithinPartitions("span", "key").write.partitionBy("span").parquet(run.path)
        return run

    def _read(self, run: Run) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(run.path)

    def add(self, accepted: DataFrame) -> None:
        """Add a run of accepted captures (id, digest, high, low); more than RUNS of a level are merged into one of the next."""
        keyed = accepted.select("id", "digest", "high", "low", F.inline(first_keys()))
        rows = keyed.select("key", "id", F.when(F.col("number") == DIGEST, F.col("digest")).alias("digest"), *[F.when(F.col("number") < DIGEST, F.col(c)).alias(c) for c in ("high", "low")])
        self.runs.append(self._write(rows, accepted.count() * (KEYS + 1), 0))
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) > RUNS:
            every = reduce(DataFrame.unionByName, [self._read(r).drop("span") for r in full])
            merged = self._write(every, every.count(), level + 1)
            self.runs = [r for r in self.runs if r.level != level] + [merged]
            for r in full:
                drop(self.spark, r.path)
            level += 1

    def scan(self, keys: DataFrame) -> DataFrame | None:
        """The stored rows in the ranges in which ``keys`` (key) lie: folders of other ranges aren't listed, and the bounds of the
        keys are pushed down as far as they are few. Null without history."""
        if not self.runs:
            return None
        span = F.shiftrightunsigned("key", 63 - SPAN_BITS).cast("int")
        bounds = [tuple(r) for r in keys.groupBy(span.alias("s")).agg(F.min("key"), F.max("key")).collect()]  # at most 2 ** SPAN_BITS
        out = None
        for run in self.runs:
            own: dict[int, tuple[int, int]] = {}
            for s, low, high in bounds:
                at = s >> (SPAN_BITS - run.bits)
                own[at] = (min(low, own[at][0]), max(high, own[at][1])) if at in own else (low, high)
            rows = self._read(run).filter(F.col("span").isin(list(own)) if own else F.lit(False))
            pushed = [(low, high) for _, low, high in bounds] if len(bounds) <= PUSHED else list(own.values())
            if 0 < len(pushed) <= PUSHED:
                rows = rows.filter(_either([F.col("key").between(low, high) for low, high in sorted(pushed)]))
            rows = rows.drop("span")
            out = rows if out is None else out.unionByName(rows)
        return out

    def touched(self, keys: DataFrame) -> DataFrame | None:
        """The stored rows with any of ``keys``, each with its number."""
        rows = self.scan(keys)
        return None if rows is None else rows.join(keys, "key", "left_semi").withColumn("number", F.shiftrightunsigned("key", 60).cast("int"))

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Accept or refuse the captures of one or more batches that arrive after all earlier ones.

        ``batch``: id, batch, digest, high, low. Returns (id, first): each refused capture with the smallest accepted
        id that it repeats, and adds the accepted ones to the history.
        """
        rank = F.struct(F.col("batch").isNull().alias("late"), F.col("batch"), F.col("id"))
        fp = F.when(F.col("high").isNotNull(), F.struct("high", "low"))
        batch = batch.withColumn("rank", rank).withColumn("fp", fp)
        # captures of the same digest and fingerprint stand or fall together: the earliest speaks for them
        nodes = batch.groupBy("digest", "fp").agg(F.min("rank").alias("rank"))
        nodes = keep(nodes.select(F.col("rank.id").alias("node"), "rank", "digest", "fp", F.col("fp.high"), F.col("fp.low")), "nodes")
        new = keep(nodes.filter("fp is not null").select("fp", "high", "low").distinct().select("fp", "high", "low", F.inline(_part_keys(1))), "new")

        # what each node repeats of the history: the least id by digest and by near fingerprint
        keys = new.select("key").unionByName(nodes.filter("digest is not null").select(_numbered(DIGEST, F.xxhash64("digest")).alias("key"))).distinct()
        past = self.touched(keys)
        if past is None:
            seen = nodes.withColumn("past", F.lit(None).cast("bigint"))
        else:
            past = keep(past, "touched")
            prints = past.filter(F.col("number") < DIGEST).withColumn("fp", F.struct("high", "low"))
            by_fp = near_pairs(new, prints, "id").groupBy(F.col("node").alias("fp")).agg(F.min("id").alias("past_f"))
            by_digest = past.filter(F.col("number") == DIGEST).groupBy("digest").agg(F.min("id").alias("past_d"))
            seen = nodes.join(by_fp, "fp", "left").join(by_digest, "digest", "left").withColumn("past", F.least("past_f", "past_d")).drop("past_f", "past_d")
            seen = keep(seen, "seen")
        open_ = seen.filter("past is null").drop("past")
        first, open_ = self._thin(open_, new)
        standing = open_.select("fp") if first is None else open_.select("fp").unionByName(first.select("fp"))
        windows = new.join(standing.filter("fp is not null").distinct(), "fp", "left_semi")
        links = keep(near_pairs(new, windows, narrow=first is not None).distinct(), "near").withColumnRenamed("other", "to")  # has each standing (fp, fp) itself
        accepted = self._settle(open_, links)
        if first is not None:
            accepted = accepted.unionByName(first.select(*accepted.columns))

        # the smallest accepted id that each one repeats, in the history or before it in the batch
        now = accepted.select("digest", F.col("fp").alias("to"), F.struct("rank", F.col("node").alias("id")).alias("a"))
        linked = seen.select("node", "digest").join(now.select("digest", "a"), "digest").select("node", "a")
        linked = linked.unionByName(seen.select("node", "fp").join(links.withColumnRenamed("node", "fp"), "fp").join(now.select("to", "a"), "to").select("node", "a"))
        groups = seen.join(linked.groupBy("node").agg(F.collect_set("a").alias("now")), "node", "left").select(F.col("digest").alias("d"), F.col("fp").alias("f"), "past", "now")
        before = F.array_min(F.transform(F.filter("now", lambda a: a["rank"] < F.col("rank")), lambda a: a["id"]))
        member = batch.join(groups, F.col("digest").eqNullSafe(F.col("d")) & F.col("fp").eqNullSafe(F.col("f")))
        refused = keep(member.select("id", F.least("past", before).alias("first")).filter("first is not null"), "refused")
        self.add(accepted.select(F.col("node").alias("id"), "digest", "high", "low"))
        return refused

    @staticmethod
    def _thin(open_: DataFrame, new: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """(accepted nodes, nodes still open): rounds for batches with a great many fingerprints of one screen.

        While a window holds more than WINDOW open fingerprints, the nodes that come first in all their windows are accepted, and
        each node is compared with the first ones of its windows only, so a window costs no more than its members. Rounds end
        when they settle less than a share of what is open; what is left is compared by ``near_pairs``.
        """
        done, n = None, None
        while True:
            fps = open_.filter("fp is not null").select("fp").distinct()
            wide = new.join(fps, "fp", "left_semi").groupBy("number", "key").count().filter(F.col("count") > WINDOW)
            if wide.isEmpty():
                return done, open_
            keyed = keep(open_.select("*", F.explode(first_keys()["key"]).alias("key")), "keyed")
            least = keyed.groupBy("key").agg(F.min("rank").alias("least"))
            leads = keyed.join(least, "key").groupBy("node").agg(F.bool_and(F.col("rank") == F.col("least")).alias("leads")).filter("leads").select("node")
            first = keep(keyed.join(leads, "node", "left_semi"), "leaders")
            a, b = keyed.alias("a"), first.alias("b")
            same = (F.col("a.digest") == F.col("b.digest")) | _near("a", "b")
            gone = a.join(b, F.col("a.key") == F.col("b.key")).filter(same).select("a.node").distinct()
            n = n or open_.count()
            open_ = keep(open_.join(gone, "node", "left_anti"), "open")
            one = first.drop("key").distinct()
            done = one if done is None else done.unionByName(one)
            left = open_.count()
            if n - left < THINNED * n:
                return done, open_
            n = left

    def _settle(self, nodes: DataFrame, links: DataFrame) -> DataFrame:
        """The nodes that repeat no accepted node before them.

        In each round a node that comes first among all its open neighbours is accepted, and its neighbours are refused;
        neighbourhoods are least ranks by digest and by fingerprint, so a large group costs one row for each member.
        """
        done = None
        open_ = nodes
        near = links.withColumnRenamed("node", "fp")
        while True:
            by_digest = open_.filter("digest is not null").groupBy("digest").agg(F.min("rank").alias("least_d"))
            by_fp = open_.filter("fp is not null").groupBy("fp").agg(F.min("rank").alias("least"))
            around = near.join(by_fp.withColumnRenamed("fp", "to"), "to").groupBy("fp").agg(F.min("least").alias("least_f"))
            seen = open_.join(by_digest, "digest", "left").join(around, "fp", "left")
            first = keep(seen.filter((F.coalesce("least_d", "rank") >= F.col("rank")) & (F.coalesce("least_f", "rank") >= F.col("rank"))).select(*nodes.columns), "first")
            done = first if done is None else done.unionByName(first)
            gone_d = first.select("digest").filter("digest is not null").distinct()
            gone_f = near.join(first.select(F.col("fp").alias("to")).filter("to is not null").distinct(), "to", "left_semi").select("fp").distinct()
            rest = open_.join(gone_d, "digest", "left_anti").join(gone_f, "fp", "left_anti").join(first.select("node"), "node", "left_anti")
            open_ = keep(rest.select(*nodes.columns), "open")
            left = open_.limit(SETTLED + 1).count()
            if left == 0:
                return done
            if left <= SETTLED:
                fps = open_.select("fp").filter("fp is not null").distinct()
                among = near.join(fps, "fp", "left_semi").join(fps.withColumnRenamed("fp", "to"), "to", "left_semi").filter("fp <> to")
                among = keep(among.select("fp", "to"), "among")
                if among.limit(SETTLED_LINKS + 1).count() <= SETTLED_LINKS:
                    return done.unionByName(self._settle_few(open_, among))

    @staticmethod
    def _settle_few(nodes: DataFrame, links: DataFrame) -> DataFrame:
        """The same for no more than SETTLED nodes and SETTLED_LINKS links, in one task, in order of rank."""
        ready(nodes.sparkSession)
        text = lambda c: F.concat_ws(":", f"{c}.high", f"{c}.low")
        place = [F.col("rank.late").alias("late"), F.coalesce("rank.batch", F.lit(0)).alias("batch"), "node", "digest", text("fp").alias("fp")]
        rows = nodes.select(*place, F.lit(None).cast("string").alias("to")).unionByName(
            links.select(F.lit(None).cast("boolean").alias("late"), F.lit(None).cast("bigint").alias("batch"), F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("string").alias("digest"), text("fp").alias("fp"), text("to").alias("to"))
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, near = [], defaultdict(list)
            for late, batch, node, digest, fp, to in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
                if to is None:
                    order.append((late, batch, node, digest, fp or None))
                else:
                    near[fp].append(to)
            digests, fps, out = set(), set(), []
            for _, _, node, digest, fp in sorted(order, key=lambda r: r[:3]):
                if (digest is None or digest not in digests) and (fp is None or (fp not in fps and fps.isdisjoint(near[fp]))):
                    out.append(node)
                    digests.add(digest)
                    fps.add(fp)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["node"])

        return keep(nodes.join(rows.coalesce(1).mapInArrow(run, "node bigint"), "node").select(*nodes.columns), "first")


def arrivals(df: DataFrame, slices: int = SLICES, ids: str = "capture_id", batches: str = "batch_seq", exact: str = "image_hash", near: str = "image_dhash") -> DataFrame:
    """(capture_id_a, capture_id_b): each capture that repeats an accepted one, with the smallest that it repeats.

    The table arrives in ``slices`` runs of whole batches, the least slice first, each against all that was accepted
    before it. Captures without an id can be neither; a null batch comes after all others; unreadable or null hashes match nothing.
    Ids that are there twice count once, with the row of the earliest batch.
    """
    spark = df.sparkSession
    fp = fingerprint(F.col(f"`{near}`"))
    rows = df.filter(F.col(f"`{ids}`").isNotNull()).select(F.col(f"`{ids}`").cast("bigint").alias("id"), F.col(f"`{batches}`").cast("bigint").alias("batch"), digest(F.col(f"`{exact}`")).alias("digest"), fp.alias("fp"))
    one = F.struct(F.col("batch").isNull(), "batch", "digest", "fp")
    rows = keep(rows.groupBy("id").agg(F.min_by(F.struct("batch", "digest", "fp"), one).alias("r")).select("id", "r.batch", "r.digest", "r.fp.high", "r.fp.low"), "arrivals")
    bounds = rows.agg(F.percentile_approx("batch", [k / slices for k in range(1, slices)], 1000).alias("b")).first()["b"] or []
    history, out = History(spark), None
    edges = [None, *sorted(set(bounds)), None]
    for low, high in zip(edges, edges[1:]):
        part = rows
        if low is not None:
            part = part.filter((F.col("batch") > low) if high is not None else (F.col("batch") > low) | F.col("batch").isNull())
        if high is not None:
            part = part.filter(F.col("batch") <= high)
        found = history.ingest(part)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("first").alias("capture_id_a"), F.col("id").alias("capture_id_b"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return arrivals(spark.read.parquet(f"{sf}/fixture.parquet"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
