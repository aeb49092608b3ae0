"""Problem 4: spellings of one player's name as people type it, linked within a server.

A typed name is read as a given and a family name (turned round, joined, with an initial, a short form or an
abbreviated family name). Names read in full are points of a metric space under edit distance; each is assigned to
its nearest pivot, copied to the cells that the triangle inequality can't rule out, and joined exactly within the cell.
Linked points are a player. Names whose given name is in no table are points of their own, in the order in which they
are written and turned round. What isn't written in full is tied to the player that it fits best, by the same join over
the forms of all players: the initial with the family name, and both names joined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ready, spread
from ..operators.skew import REFERENCE_ROWS
from ..scratch import keep
from .automaton import Automaton, Trie
from .characters import plain
from .components import components

#: Edit distance within which two full names are one, and the least letters of a family name for it; 1 below that.
RADIUS, LONG_FAMILY = 2, 6
#: Pivots, and names of which they are chosen, at least and at most: pivots grow with the root of the largest server's
#: names, so that neither the distances to pivots nor the cells grow faster than that. LONGEST letters for a pivot.
PIVOTS, SAMPLE = (16, 512), (600, 2048)
LONGEST = 256
VOWELS = "aeiou"
#: Words that a task remembers the given names of.
MEMO = 200_000


class GivenNames:
    """Given names and their short forms, found in spite of a misspelling."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.exact: dict[str, str] = {}
        for nick, full in pairs:
            self.exact[full.lower()] = full.lower()
        for nick, full in pairs:
            self.exact.setdefault(nick.lower(), full.lower())
        self.longest = max(map(len, self.exact), default=0)
        self.givens = set(self.exact.values())
        self.trie = Trie()
        for word, full in self.exact.items():
            self.trie.add(word, (full, word != full))
        self.automata = (Automaton(1), Automaton(2))
        self.known: dict[str, tuple[tuple[str, int] | None, list[str]]] = {}

    def find(self, word: str) -> tuple[str, int] | None:
        """(given name, errors) if one and only one is nearest; short forms may have one error, full ones of seven letters two."""
        return self.nearest(word)[0]

    def nearest(self, word: str) -> tuple[tuple[str, int] | None, list[str]]:
        """What ``find`` gives, and the given names that are equally near if there are several; a full memo only costs time."""
        if word in self.known:
            return self.known[word]
        out, tied = None, []
        if word in self.exact:
            out = (self.exact[word], 0)
        elif len(word) >= 4:
            for errors in (1, 2) if len(word) >= 7 else (1,):
                hits = {full for (full, short), e in self.trie.search(word, self.automata[errors - 1]).items() if e == errors and not (short and e > 1)}
                if hits:
                    out = (min(hits), errors) if len(hits) == 1 else None
                    tied = sorted(hits) if out is None else []
                    break
        if len(self.known) < MEMO:
            self.known[word] = (out, tied)
        return out, tied


def read_name(name: str, names: GivenNames) -> list[tuple[str, str]]:
    """(given, family) readings in lower case, the likelier first; the given name may be one letter, or empty if unknown.

    A given name as near to several known ones has a reading for each of them, all with the same family name.
    """
    text = " ".join(plain(name).split())
    turned = "," in text
    parts = [re.sub(r"[^\w]|[\d_]", "", p) for p in re.split(r"[,\s]+|(?<=\w)\.(?=\w)", text)]
    parts = [p for p in parts if p]
    if len(parts) == 1:
        word = parts[0]
        caps = [i for i in range(1, len(word)) if word[i].isupper() and not word[i - 1].isupper()]
        if caps and not word.isupper():
            parts = [word[: caps[0]], word[caps[0] :]]
        else:
            return [_split(word.lower(), names)]
    if len(parts) > 2:
        parts = [parts[0], "".join(parts[1:])] if not turned else ["".join(parts[:-1]), parts[-1]]
    if not parts:
        return []
    a, b = (p.lower() for p in parts)
    if turned:
        a, b = b, a
    if len(a) == 1 or len(b) == 1:
        return [(a, b)] if len(a) == 1 else [(b, a)]
    (first, tied_first), (second, tied_second) = names.nearest(a), names.nearest(b)
    if not first and not second:
        for tied, family in ((tied_first, b), (tied_second, a)):
            if tied:
                return [(g, family) for g in tied]
    if turned and (first or not second):
        return [(first[0] if first else a, b)]
    if first and (not second or first[1] <= second[1]):
        return [(first[0], b)] + ([(second[0], a)] if second and second[1] == first[1] else [])
    if second:
        return [(second[0], a)]
    return [(a, b), (b, a)]


def _split(word: str, names: GivenNames) -> tuple[str, str]:
    """A joined name, parted where a given name begins or ends: a known one if there is one, else one that is misspelt."""
    # no longer beginning or end can be a given name, so a very long word costs no more than another
    parts = [p for i in range(min(len(word) - 2, names.longest + 2), 1, -1) for p in ((word[:i], word[i:]), (word[-i:], word[:-i]))]
    for given, family in parts:
        if given in names.exact:
            return names.exact[given], family
    best = None
    for given, family in parts:
        if hit := names.find(given):
            rank = (hit[1], -len(given))
            if best is None or rank < best[0]:
                best = (rank, (hit[0], family))
    return best[1] if best else ("", word)


def consonants(word: str) -> str:
    return "".join(c for c in word if c not in VOWELS)


#: Words of two letters or more that end in a full stop: an abbreviation, if it is the family name.
_CUT = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,})\.(?!\w)")
_READ = "server_id bigint, name string, n bigint, kind string, given string, family string, text string"


def readings(name: str, names: GivenNames) -> list[tuple[str, str, str, str]]:
    """(kind, given, family, text) of each way to read a name. Kinds:

    ``full`` names of a known given name; ``part``, one of several known given names that may be meant, or a name of an unknown
    given name; ``pair`` and ``turn``, a name of two unknown words as written and turned round; ``initial`` with the family
    name; ``short``, a family name without vowels; ``cut``, one that ends in a full stop; ``odd``, no family name found.
    """
    found = read_name(name, names)
    if not found or not found[0][0]:
        return [("odd", "", "", "".join(c for c in plain(name).lower() if c.isalpha()) or plain(name))]
    cut = {m.lower() for m in _CUT.findall(plain(name))}
    sure = len(found) == 1 or found[0][1] != found[1][1]
    unknown = len(found) == 2 and found[0] == found[1][::-1] and names.find(found[0][0]) is None and names.find(found[1][0]) is None
    out = []
    for k, (given, family) in enumerate(found):
        text = f"{given} {family}"
        if family in cut:
            out.append(("cut", given, family, text))
        elif not any(c in VOWELS for c in family):
            out.append(("short", given, family, family))
        elif len(given) == 1:
            out.append(("initial", given, family, text))
        elif unknown:
            whole = not any(w in cut or not any(c in VOWELS for c in w) for w in (given, family))
            out.append(("part", given, family, text))
            if whole:
                out.append(("pair" if k == 0 else "turn", given, family, text))
        else:
            out.append(("full" if k == 0 and sure and given in names.givens else "part", given, family, text))
            if k == 0 and len(found) == 1 and given not in names.givens:
                out.append(("pair", given, family, text))
    return out


def read_names(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Rows of (server_id, name, n) with a row for each of their ``readings``."""
    spark = names.sparkSession
    ready(spark)
    pairs = nicknames.select("nick", "full_given").filter("trim(nick) <> '' and trim(full_given) <> ''").limit(REFERENCE_ROWS + 1).collect()
    if len(pairs) > REFERENCE_ROWS:
        raise ValueError(f"more than {REFERENCE_ROWS} nicknames")
    shared = spark.sparkContext.broadcast([tuple(p) for p in pairs])
    built: list[GivenNames] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(GivenNames(shared.value))
        for batch in batches:
            out = [(s, x, n, *r) for s, x, n in zip(*(batch.column(i).to_pylist() for i in range(3))) for r in readings(x, built[0])]
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _READ.split(", ")])

    return names.select(F.col("server_id").cast("bigint"), "name", "n").mapInArrow(run, _READ)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance, with the columns of the table as bits."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right & last) - bool(left & last)
        right = right << 1 | 1
        left <<= 1
        up, down = (left | ~(diagonal | right)) & full, right & diagonal & full
    return score


def choose_pivots(points: DataFrame, keys: tuple[str, ...] = ("server_id",)) -> list[str]:
    """Names, each as far as can be from those before, among a bounded sample that every run draws alike."""
    most = points.groupBy(*keys).count().agg(F.max("count").alias("n")).first().n
    if not most:
        return []
    wanted = min(PIVOTS[1], max(PIVOTS[0], 1 << round(math.log2(most) / 2)))
    sample = min(SAMPLE[1], max(SAMPLE[0], 4 * wanted))
    # very long names are no pivots, as the driver compares them with each other; any text may be one
    names = [r.text for r in points.select("text").filter(F.length("text") <= LONGEST).distinct().orderBy(F.xxhash64("text"), "text").limit(sample).collect()] or [""]
    pivots, far = [names[0]], [edit_distance(names[0], x) for x in names]
    while len(pivots) < wanted and max(far) > 2 * RADIUS:
        p = names[max(range(len(names)), key=far.__getitem__)]
        pivots.append(p)
        far = [min(d, edit_distance(p, x)) for d, x in zip(far, names)]
    return pivots


def cells(points: DataFrame, pivots: list[str], radius: int) -> DataFrame:
    """``points`` with the array ``cells`` of (cell, home): the cell of the nearest pivot, and all that may hold a point
    within ``radius`` of one at home there: those whose pivot is at most twice the radius farther than the nearest."""
    distances = F.transform(F.array(*[F.lit(p) for p in pivots]), lambda p: F.levenshtein(F.col("text"), p))
    # a generator holds its value: the distances are worked out once, not again wherever they are used
    held = lambda c: F.explode(F.array(c))
    d = points.select("*", held(distances).alias("d")).select("*", held(F.array_min("d")).alias("least"))
    d = d.select("*", held((F.array_position("d", F.col("least")) - 1).cast("int")).alias("nearest"))
    reach = F.col("least") + 2 * radius
    all_ = F.filter(
        F.transform("d", lambda x, i: F.struct(i.alias("cell"), (i == F.col("nearest")).alias("home"), x.alias("far"))), lambda c: c["far"] <= reach
    )
    return d.withColumn("cells", all_).drop("d", "least", "nearest")


def radius_join(left: DataFrame, right: DataFrame, radius: int, pivots: list[str], keys: tuple[str, ...] = ("server_id",)) -> DataFrame:
    """(keys, text, other, distance): all pairs of equal keys within ``radius``; both sides are distinct (keys, text).

    The left name stays in its home cell, the right one is copied over boundaries, so each pair is met once.
    """
    a = cells(spread(left, *keys, "text"), pivots, radius).select(*keys, "text", F.inline("cells")).filter("home").select(*keys, "text", "cell")
    b = cells(spread(right, *keys, "text"), pivots, radius).hint("merge").select(*keys, F.col("text").alias("other"), F.inline("cells")).select(*keys, "other", "cell")
    distance = F.when(F.col("text") == F.col("other"), 0).otherwise(F.levenshtein("text", "other", radius))
    return a.join(b, [*keys, "cell"]).withColumn("distance", distance).filter("distance >= 0").select(*keys, "text", "other", "distance")


def _family(text: str) -> Column:
    return F.substring_index(text, " ", -1)


def close_enough(distance: Column, text: str, other: str) -> Column:
    """Whether two full names of known given names, or two initials with family names, may be one."""
    family = F.least(F.length(_family(text)), F.length(_family(other)))
    return distance <= F.when(family >= LONG_FAMILY, RADIUS).otherwise(1)


def words_agree(text: str, other: str) -> Column:
    """Whether each of the two words of a name may be the other's: one error from four letters on, two from LONG_FAMILY on."""
    out = F.lit(True)
    for k in (1, -1):
        a, b = F.substring_index(text, " ", k), F.substring_index(other, " ", k)
        n = F.least(F.length(a), F.length(b))
        distance = F.when(a == b, 0).otherwise(F.levenshtein(a, b, RADIUS))  # -1 beyond the radius
        out = out & distance.between(0, F.when(n >= LONG_FAMILY, RADIUS).when(n >= 4, 1).otherwise(0))
    return out


def _id(c: str) -> Column:
    return F.concat_ws("\t", "server_id", c)


def linked_points(points: DataFrame, links: DataFrame) -> DataFrame:
    """``points`` (server_id, text, ...) with ``player``, the least of the points that ``links`` (server_id, text, other) join."""
    roots = components(links.select(_id("text").alias("a"), _id("other").alias("b")))
    return keep(points.withColumn("node", _id("text")).join(roots, "node", "left").withColumn("player", F.coalesce("root", "node")).drop("root", "node"), "known")


def _points(read: DataFrame, kind: str) -> DataFrame:
    return keep(read.filter(F.col("kind") == kind).groupBy("server_id", "text", "given", "family").agg(F.sum("n").alias("n")), "points")


def _best(candidates: DataFrame) -> DataFrame:
    """(server_id, name, player): of the players that a name may mean, the nearest, then the largest."""
    best = F.max_by("player", F.struct((-F.col("distance")).alias("near"), "size", "player"))
    return candidates.groupBy("server_id", "name").agg(best.alias("player"))


def _sized(known: DataFrame) -> DataFrame:
    return known.join(known.groupBy("player").agg(F.sum("n").alias("size")), "player")


def _known_names(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names tied to players of known given names, the points of those players)."""
    points = _points(read, "full")
    pivots = choose_pivots(points)
    texts = points.select("server_id", "text")
    if pivots:
        probes = texts.unionByName(read.filter("kind = 'part'").select("server_id", "text")).distinct()
        near = radius_join(probes, texts, RADIUS, pivots)
        near = keep(near.filter(close_enough(F.col("distance"), "text", "other")), "near")
    else:
        near = points.select("server_id", "text", F.col("text").alias("other"), F.lit(0).alias("distance"))
    known = linked_points(points, near.join(texts, ["server_id", "text"], "left_semi"))
    own = read.filter("kind = 'full'").join(known.select("server_id", "text", "player"), ["server_id", "text"]).select("server_id", "name", "player")
    part = read.filter("kind = 'part'").join(own.select("server_id", "name"), ["server_id", "name"], "left_anti")
    part = part.select("server_id", "name", "text").join(near, ["server_id", "text"])
    part = part.join(_sized(known).select("server_id", F.col("text").alias("other"), "player", "size"), ["server_id", "other"])
    return keep(own.unionByName(_best(part)), "players"), known


def _unknown_names(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for names of two words of which no table knows either, among themselves, as written and turned round."""
    points = _points(left, "pair")
    texts = points.select("server_id", "text")
    pivots = choose_pivots(points)
    if pivots:
        turned = left.filter("kind = 'turn'").select("server_id", "text", F.concat_ws(" ", "family", "given").alias("own")).distinct()
        near = radius_join(texts.unionByName(turned.select("server_id", "text")).distinct(), texts, RADIUS, pivots)
        near = keep(near.filter(words_agree("text", "other")).select("server_id", "text", "other"), "near")
        links = near.join(texts, ["server_id", "text"], "left_semi").unionByName(near.join(turned, ["server_id", "text"]).select("server_id", F.col("own").alias("text"), "other"))
    else:
        links = texts.withColumn("other", F.col("text"))
    known = linked_points(points, links)
    return left.filter("kind = 'pair'").join(known.select("server_id", "text", "player"), ["server_id", "text"]).select("server_id", "name", "player"), known


def _not_in_full(left: DataFrame, known: DataFrame) -> DataFrame:
    """(server_id, name, player) of names with an initial, a joined or an abbreviated name, tied to the player that they fit best."""
    sized = _sized(known).select("server_id", "given", "family", "player", "size")
    initial = F.substring("given", 1, 1)
    forms = F.array(F.struct(initial.alias("mark"), F.concat_ws(" ", initial, "family").alias("form")), *[F.struct(F.lit("").alias("mark"), F.concat(a, b).alias("form")) for a, b in (("given", "family"), ("family", "given"))])
    # a player's largest form counts; forms of letters that no name needs aren't joined
    probes = left.filter("kind in ('initial', 'odd')").select("server_id", "name", F.when(F.col("kind") == "initial", F.col("given")).otherwise("").alias("mark"), "text")
    probes = keep(probes, "probes")
    every = sized.select("server_id", "player", "size", F.inline(forms)).withColumnRenamed("form", "text").join(probes.select("server_id", "mark").distinct(), ["server_id", "mark"], "left_semi")
    every = keep(every.groupBy("server_id", "mark", "text", "player").agg(F.max("size").alias("size")), "forms")
    keys = ("server_id", "mark")
    pivots = choose_pivots(every.select(*keys, "text").distinct(), keys)
    near = None
    if pivots:
        near = radius_join(probes.select(*keys, "text").distinct(), every.select(*keys, "text").distinct(), RADIUS, pivots, keys)
        near = near.filter((F.col("mark") == "") | close_enough(F.col("distance"), "text", "other"))
        near = probes.join(near, [*keys, "text"]).join(every.withColumnRenamed("text", "other"), [*keys, "other"]).select("server_id", "name", "player", "distance", "size")
    bare = F.regexp_replace("family", f"[{VOWELS}]", "")
    short = left.filter("kind = 'short'").select("server_id", "name", "given", F.col("family").alias("key"))
    first = sized.select("server_id", F.explode(F.array_distinct(F.array("given", initial))).alias("given"), "family", "player", "size")
    short = short.join(first.select("server_id", "given", bare.alias("key"), "player", "size").distinct(), ["server_id", "given", "key"]).select("server_id", "name", "player", F.lit(0).alias("distance"), "size")
    head = lambda c: F.substring(c, 1, 2)
    cut = left.filter("kind = 'cut'").select("server_id", "name", "given", F.col("family").alias("begin"), head("family").alias("head"))
    cut = cut.join(first.withColumn("head", head("family")), ["server_id", "given", "head"]).filter(F.startswith("family", "begin") | F.startswith(bare, F.col("begin")))
    tied = short.unionByName(cut.select("server_id", "name", "player", F.lit(0).alias("distance"), "size"))
    return _best(tied if near is None else near.unionByName(tied))


def players(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(server_id, name, player): who is meant by each distinct name of a server; names that fit nobody are on their own."""
    read = keep(read_names(spread(names, "server_id", "name"), nicknames), "read")
    by = ["server_id", "name"]
    found, known = _known_names(read)
    left = keep(read.join(found, by, "left_anti"), "left")
    own, more = _unknown_names(left)
    found = keep(found.unionByName(own), "players")
    rest = left.join(found, by, "left_anti")
    found = keep(found.unionByName(_not_in_full(rest, known.unionByName(more))), "players")
    # names that fit no full one are linked with what is written alike
    alone = read.join(found, by, "left_anti").groupBy(*by).agg(F.min(F.concat_ws("\t", "server_id", "kind", "given", "family", "text")).alias("player"))
    return found.unionByName(alone)


def members(entries: DataFrame, nicknames: DataFrame, mode: str = "typed") -> DataFrame:
    """(player, entry_id, name): the player that each entry typed by a person means; players of different servers differ.

    Null and blank names, entries without a server and without an id are left out.
    """
    typed = entries.filter(F.col("entry_mode") == mode).filter("trim(player_name) <> '' and server_id is not null and entry_id is not null")
    typed = typed.select("entry_id", F.col("server_id").cast("bigint").alias("server_id"), F.col("player_name").alias("name"))
    names = typed.groupBy("server_id", "name").agg(F.count("*").alias("n"))
    return typed.join(players(names, nicknames), ["server_id", "name"]).select("player", "entry_id", "name")


def variants(entries: DataFrame, nicknames: DataFrame, mode: str = "typed") -> DataFrame:
    """(entry_id_a, entry_id_b): entries of one server typed by people that mean the same player under unequal strings.

    Null and blank names, entries without a server and without an id are linked with nothing. The same string twice is
    no pair, but both entries are linked with every other spelling.
    """
    who = keep(members(entries, nicknames, mode), "who")
    a = who.select("player", F.col("entry_id").alias("entry_id_a"), F.col("name").alias("name_a"))
    b = who.select("player", F.col("entry_id").alias("entry_id_b"), F.col("name").alias("name_b"))
    return a.join(b, "player").filter("entry_id_a < entry_id_b and name_a <> name_b").select("entry_id_a", "entry_id_b")


def _tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("player_entry", "nickname")]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return variants(*_tables(spark, sf))


def p4_players(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each typed entry with its player: linear in the entries, however many spellings a player has."""
    return members(*_tables(spark, sf)).select("entry_id", "player")


QUERIES = {"p4_found": p4_found, "p4_players": p4_players}
SQL: dict[str, str] = {}
