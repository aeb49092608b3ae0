"""Problem 2: text that looks the same but is made of other characters, brought to one form."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import spread
from ..operators.skew import broadcast_if_small, join_to_unique
from ..scratch import keep
from .characters import LOOKALIKES, changing, combining, compositions

_PARTS = "array<struct<c:string,class:int,like:string>>"


@cache
def _pairs() -> list[tuple[str, str]]:
    """(two characters, the one that they are): the single steps of composition."""
    out = []
    for _, c in compositions():
        parts = unicodedata.decomposition(c).split()  # none for Hangul, whose syllables follow from their place
        if len(parts) == 2:
            out.append(("".join(chr(int(p, 16)) for p in parts), c))
    return out


@cache
def _rules() -> tuple[list, list]:
    def parts(d: str) -> list:
        return [(c, combining(c), LOOKALIKES.get(c, c)) for c in d]

    known = changing()
    seen = {c for c, _ in known}
    return [(c, parts(d)) for c, d in known] + [(c, parts(c)) for c in LOOKALIKES if c not in seen], compositions()


def rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(decompositions with look-alikes, compositions): two tables of a size set by the Unicode database, some 20,000 rows."""
    first, second = _rules()
    return spark.createDataFrame(first, f"ch string, parts {_PARTS}"), spark.createDataFrame(second, "apart string, whole string")


def rebuild(texts: DataFrame, text: str = "text", tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(text, plain, skeleton) of each distinct text of one column.

    ``plain`` is the composed form without invisible characters, with white space as U+0020 and forms of equal look
    (full-width and the like) resolved; ``skeleton`` has look-alike letters as Latin ones too. A null text has no row;
    a text of invisible characters only, and the empty one, have empty forms.

    Texts are exploded to code points at their places, mapped by broadcast tables of rules, marks are put in order
    of their class after their base, composed by a second table, and strings are built again. All of it after the
    one shuffle that makes texts distinct.
    """
    spark = texts.sparkSession
    mapping, composing = tables or rules(spark)
    every = texts.select(F.col(f"`{text}`").alias("text")).filter("text is not null").distinct()
    ascii = F.col("text").rlike(r"^[\x20-\x7e]*\z")  # no rule changes these, so they are their own forms
    names = spread(every.filter(~ascii), "text")
    chars = names.select("text", F.posexplode_outer(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    itself = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("class"), F.col("ch").alias("like"))).cast(_PARTS)
    pieces = chars.join(F.broadcast(mapping), "ch", "left").select("text", "pos", F.posexplode_outer(F.coalesce("parts", itself)).alias("sub", "p"))
    # a base opens a cluster, and the marks after it are its own
    pieces = pieces.select("text", "pos", "sub", "p.c", "p.class", "p.like", F.expr("sum(if(p.class = 0, 1, 0)) over (partition by text order by pos, sub)").alias("cluster"))
    order = F.array_sort(F.collect_list(F.struct("class", "pos", "sub", "c", "like")))
    clusters = pieces.groupBy("text", "cluster").agg(F.filter(order, lambda x: x["c"].isNotNull()).alias("marks"))
    table = F.broadcast(composing)
    for f, out in (("c", "plain"), ("like", "skeleton")):
        # a base with its marks is one character, or else is composed mark by mark
        joined = F.array_join(F.transform("marks", lambda x: x[f]), "")  # noqa: B023
        clusters = clusters.withColumn("apart", joined).join(table, "apart", "left")
        stepwise = F.when((F.size("marks") > 2) & (F.get("marks", F.lit(0))["class"] == 0), compose(F.col("marks"), f))
        clusters = clusters.withColumn(out, F.coalesce("whole", stepwise, "apart")).drop("apart", "whole")
    whole = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", f))), lambda x: x[f]), "")
    changed = clusters.groupBy("text").agg(whole("plain").alias("plain"), whole("skeleton").alias("skeleton"))
    return changed.unionByName(every.filter(ascii).select("text", F.col("text").alias("plain"), F.col("text").alias("skeleton")))


def compose(marks: Column, f: str) -> Column:
    """A base with its marks in order of class, as normal form C has it: a mark that isn't blocked by one that stayed before it
    joins the base if the two are one character. The pairs are a constant of some 1,000 entries, set by the Unicode database."""
    pairs = _pairs()
    known = F.map_from_arrays(F.split(F.lit(" ".join(k for k, _ in pairs)), " "), F.split(F.lit(" ".join(v for _, v in pairs)), " "))
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    def add(acc: Column, m: Column) -> Column:
        base, at, next_ = acc["base"], F.ascii(acc["base"]), F.ascii(m[f])
        # syllables of Hangul follow from their place: 21 vowels for a first consonant, 28 ends for either
        first = at.between(0x1100, 0x1112) & next_.between(0x1161, 0x1175)
        last = at.between(0xAC00, 0xD7A3) & ((at - 0xAC00) % 28 == 0) & next_.between(0x11A8, 0x11C2)
        syllable = F.when(first, point(0xAC00 + ((at - 0x1100) * 21 + next_ - 0x1161) * 28)).when(last, point(at + next_ - 0x11A7))
        one = F.when((acc["stayed"] == 0) | (acc["stayed"] < m["class"]), F.coalesce(syllable, F.try_element_at(known, F.concat(base, m[f]))))
        kept = F.struct(base.alias("base"), F.concat(acc["rest"], m[f]).alias("rest"), m["class"].alias("stayed"))
        return F.when(one.isNotNull(), F.struct(one.alias("base"), acc["rest"].alias("rest"), acc["stayed"].alias("stayed"))).otherwise(kept)

    start = F.struct(F.get(marks, F.lit(0))[f].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("stayed"))
    return F.aggregate(F.slice(marks, F.lit(2), F.size(marks)), start, add, lambda a: F.concat(a["base"], a["rest"]))


def same_look(entries: DataFrame, roster: DataFrame, name: str = "player_name", entry_id: str = "entry_id", member: str = "member_id") -> DataFrame:
    """(entry_id, member_id): entries whose name is no member's name, but looks the same as that member's.

    Null, blank and empty names are never cases. A name that looks like several members' has a row for each.
    """
    given = entries.select(F.col(f"`{entry_id}`").alias("entry_id"), F.col(f"`{name}`").alias("text")).filter("trim(text) <> ''")
    members = roster.select(F.col(f"`{member}`").alias("member_id"), F.col(f"`{name}`").alias("text")).filter("trim(text) <> ''")
    small = broadcast_if_small(members.select("text").distinct())
    other = given.join(small, "text", "left_anti")
    counts = other.groupBy("text").agg(F.count("*").alias("n"))
    tables = tuple(keep(t, "rules") for t in rules(entries.sparkSession))  # written once, read by both sides
    forms = rebuild(counts, tables=tables).filter("trim(skeleton) <> ''").select("text", "skeleton")
    own = rebuild(members, tables=tables).select("text", "skeleton").join(members, "text").select("skeleton", "member_id").distinct()
    # kept, as it is read for hot and for other names: the forms are made once
    found = keep(forms.join(broadcast_if_small(own), "skeleton").join(counts, "text").select("text", "member_id", "n"), "same-look")
    total = entries.count()
    return join_to_unique(other, found, "text", "n", total).select("entry_id", "member_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_look(spark.read.parquet(f"{sf}/player_entry.parquet"), spark.read.parquet(f"{sf}/roster.parquet"))


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every distinct name."""
    return rebuild(spark.read.parquet(f"{sf}/player_entry.parquet"), "player_name").withColumnRenamed("text", "player_name")


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
SQL: dict[str, str] = {}
