"""Problem 3: freely written values mapped to the entries of a reference list."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ready, spread
from ..operators.skew import REFERENCE_ROWS, broadcast_if_small, join_to_unique
from ..scratch import keep
from .automaton import Automaton, Trie
from .characters import plain, skeleton

#: Errors that a value may have against an entry of so many letters: (least letters, errors).
ERRORS = ((9, 2), (4, 1), (0, 0))
MOST = 2
#: What may stand before a name, in this order, each once: a rank number, a rank badge, a bracketed tag.
RANK = re.compile(r"\s*#?\d{1,4}(?:\s*[.):]+\s*|\s+|(?=[Rr][1-5]\b)|(?=[\[(]))")
BADGE = re.compile(r"\s*[Rr][1-5](?![^\W_])\s*[.:)]?\s*")
TAG = re.compile(r"\s*[\[({][^\])}]{1,10}[\])}]\s*")


def paths(value: str) -> list[str]:
    """The value, and what is left of it after the things that may stand before a name, longest first."""
    out = [value]
    for pattern in (RANK, BADGE, TAG):
        for v in list(out):
            if (m := pattern.match(v)) and m.end() < len(v):
                out.append(v[m.end() :])
    return sorted(dict.fromkeys(out), key=len, reverse=True)


def fold(name: str) -> set[tuple[str, str]]:
    """(letters, digits) in which letter case, look-alikes, spaces and punctuation are gone.

    Look-alikes are resolved before and after lowering, since capitals of another script look like other letters
    than the small ones do.
    """
    out = set()
    forms = (name.lower(),) if name.isascii() else (skeleton(name).lower(), skeleton(plain(name).lower()))
    for text in forms:
        out.add(("".join(c for c in text if c.isalpha()), "".join(c for c in text if c.isdigit())))
    return out


def allowed(letters: str) -> int:
    return next(e for least, e in ERRORS if len(letters) >= least)


class Reference:
    """A trie of the letters of all entries and their aliases for each string of digits."""

    def __init__(self, entries: list[tuple[int, str]]) -> None:
        self.tries: dict[str, Trie] = {}
        for value, name in entries:
            for letters, digits in fold(name):
                if letters or digits:
                    self.tries.setdefault(digits, Trie()).add(letters, (value, allowed(letters)))
        self.automata = [Automaton(e) for e in range(MOST + 1)]

    def readings(self, text: str) -> list[tuple[Trie, str]]:
        """The letters of the value and of what is left of it without a prefix, each with the trie of its digits."""
        parts = {f for part in paths(plain(text)) for f in fold(part)}
        return [(trie, letters) for letters, digits in sorted(parts) if (trie := self.tries.get(digits)) is not None]

    def search(self, readings: list[tuple[Trie, str]], most: int) -> dict[int, int]:
        found: dict[int, int] = {}
        for trie, letters in readings:
            for (v, may), e in trie.search(letters, self.automata[most]).items():
                if e <= may:
                    found[v] = min(e, found.get(v, e))
        return found

    def within(self, text: str) -> dict[int, int]:
        """All entries within the distance that their length allows, by the value or a part of it, with their distances."""
        return self.search(self.readings(text), MOST)

    def closest(self, text: str) -> tuple[int, int] | None:
        """(entry, distance) at the least distance, the smallest one of equals; wider automata run only where narrower ones find nothing."""
        if readings := self.readings(text):
            for most in range(MOST + 1):
                if found := self.search(readings, most):
                    return min(found.items(), key=lambda f: (f[1], f[0]))
        return None


def values(entries: DataFrame, entry_id: str = "entry_id", name: str = "player_name", candidates: str = "candidates") -> DataFrame:
    """(entry_id, cand_ord, value): an entry's own name at -1 and those of its candidates at their places."""
    c = F.transform(F.col(f"`{candidates}`"), lambda x, i: F.struct(i.cast("int").alias("cand_ord"), x[name].alias("value")))
    own = F.array(F.struct(F.lit(-1).alias("cand_ord"), F.col(f"`{name}`").alias("value")))
    none = F.filter(own, lambda _: F.lit(False))
    return entries.select(F.col(f"`{entry_id}`").alias("entry_id"), F.inline(F.concat(own, F.coalesce(c, none))))


def not_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "") != ""


def match(texts: DataFrame, roster: DataFrame, name: str = "player_name", member: str = "member_id", every: bool = False) -> DataFrame:
    """(value, n, member_id, errors): the closest entry of the reference list for each row of (value, n), or -1 and null. With ``every``, all
    entries within the distance that their length allows, and no row for a value without any.

    The list is held in each worker as tries, so it may have at most REFERENCE_ROWS rows; a longer one is refused.
    Null and blank entries are no entries; of a name that is there twice the smallest id counts.
    """
    spark = texts.sparkSession
    ready(spark)
    rows = roster.select(F.col(f"`{member}`").alias("m"), F.col(f"`{name}`").alias("n")).filter("m is not null and n is not null").limit(REFERENCE_ROWS + 1).collect()
    if len(rows) > REFERENCE_ROWS:
        raise ValueError(f"the reference list has more than {REFERENCE_ROWS} rows")
    entries = spark.sparkContext.broadcast([(r.m, r.n) for r in rows])
    built: list[Reference] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Reference(entries.value))
        for batch in batches:
            at, ids, errors = [], [], []
            for i, t in enumerate(batch.column(0).to_pylist()):
                found = built[0].within(t) if every else {-1: None} if (c := built[0].closest(t)) is None else dict([c])
                for m, e in sorted(found.items()):
                    at.append(i)
                    ids.append(m)
                    errors.append(e)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(ids, pa.int64()), pa.array(errors, pa.int32())], names=["value", "n", "member_id", "errors"])

    return texts.select("value", "n").mapInArrow(run, "value string, n bigint, member_id bigint, errors int")


def to_members(entries: DataFrame, roster: DataFrame, name: str = "player_name") -> DataFrame:
    """(entry_id, cand_ord, member_id): each value that is no roster name itself, with the member meant or -1.

    Null and blank values have no row; a value of punctuation only belongs to none.
    """
    given = values(entries, name=name).filter(not_blank(F.col("value")))
    exact = broadcast_if_small(roster.select(F.col(f"`{name}`").alias("value")).distinct())
    other = given.join(exact, "value", "left_anti")
    counts = other.groupBy("value").agg(F.count("*").alias("n"))
    found = keep(match(spread(counts, "value"), roster, name), "meant")
    return join_to_unique(other, found, "value", "n", entries.count()).select("entry_id", "cand_ord", "member_id")


def within(entries: DataFrame, roster: DataFrame, name: str = "player_name") -> DataFrame:
    """(value, n, member_id, errors): for each distinct value, how often it is there, and every entry of the list within the distance
    that its length allows, with that distance. Roster names themselves are among the values; values without an entry have no row."""
    given = values(entries, name=name).filter(not_blank(F.col("value"))).groupBy("value").agg(F.count("*").alias("n"))
    return match(spread(given, "value"), roster, name, every=True)


def p3_within(spark: SparkSession, sf: str) -> DataFrame:
    return within(spark.read.parquet(f"{sf}/player_entry.parquet"), spark.read.parquet(f"{sf}/roster.parquet"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return to_members(spark.read.parquet(f"{sf}/player_entry.parquet"), spark.read.parquet(f"{sf}/roster.parquet"))


QUERIES = {"p3_found": p3_found, "p3_within": p3_within}
SQL: dict[str, str] = {}
