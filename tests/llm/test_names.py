import itertools
import random
import unicodedata

import pytest

from rankloom.llm.automaton import Automaton, Trie
from rankloom.llm.canonical import Reference, paths, to_members, values, within
from rankloom.llm.characters import plain, skeleton
from rankloom.llm.components import components
from rankloom.llm.lookalike import rebuild, same_look
from rankloom.llm.variants import GivenNames, edit_distance, members, radius_join, read_name, variants


def distance(a, b, swaps=True):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def random_words(n, letters="abc", longest=8, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_automaton_against_brute_force(most):
    trie, automaton, entries = Trie(), Automaton(most), set(random_words(200))
    for e in entries:
        trie.add(e, e)
    for w in random_words(150, seed=6):
        assert trie.search(w, automaton) == {e: d for e in entries if (d := distance(w, e)) <= most}


def test_edit_distance_against_brute_force():
    a, b = random_words(200, "abcd", 20, 1), random_words(200, "abcd", 20, 2)
    assert [edit_distance(x, y) for x, y in zip(a, b)] == [distance(x, y, swaps=False) for x, y in zip(a, b)]


def test_rebuild_against_the_unicode_database(spark):
    texts = ["é", "é", "ǖ", "ǖ", "각", "각", "á̧", "á̧", "ﬁx", "𝐀b", "", "​", "x́̂y", "ṩ", "  z", "ế", "Ｚｕs﻿k", "x²", None, "a" * 3000]
    got = {r.text: (r.plain, r.skeleton) for r in rebuild(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {t: (plain(t), skeleton(t)) for t in texts if t is not None}
    for t in ("é", "각", "ǖ", "ế"):
        assert plain(unicodedata.normalize("NFD", t)) == t


def test_composition_of_bases_with_several_marks(spark):
    """Every order of up to three marks on bases that compose with some of them, against the Unicode database."""
    marks = ["\u0301", "\u0302", "\u0306", "\u031b", "\u0323", "\u0327", "\u0308"]
    bases = ["a", "A", "e", "o", "u", "\u03b1", "x", "\u1100", "\uac00", "\u0438"]
    texts = {b + "".join(m) for b in bases for n in (1, 2, 3) for m in itertools.permutations(marks, n)}
    texts |= {"\u1100\u1161\u11a8\u0301", "\uac00\u11a8\u0301\u0323", "\u0301a", "a\u0323\u0302\u0301"}
    got = {r.text: (r.plain, r.skeleton) for r in rebuild(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert len(texts) > 2000 and got == {t: (plain(t), skeleton(t)) for t in texts}
    assert got["a\u0323\u0302\u0301"][0] == "\u1ead\u0301"


ROSTER = "member_id long, player_name string, note string"
ENTRIES = "entry_id long, player_name string, candidates array<struct<player_name:string,score:long>>, note int"


@pytest.fixture(scope="module")
def roster(spark):
    rows = [(1, "Zuskuš"), (2, "Feral Cobra"), (3, "Captain12"), (4, "Captain13"), (5, "Ведро"), (6, None), (7, ""), (8, "Longername Here")]
    return spark.createDataFrame([(m, n, "x") for m, n in rows], ROSTER)


def test_same_look(spark, roster):
    names = ["Zuskuš", "Ｚuskuš", "zuskuš", "Zu​skuš", "Feral Cobra", "FeralCobra", "Fеral Cobra", None, " ", "", "​", "Captain１2", "Captain14", "Beдpo"]
    df = spark.createDataFrame([(i, n, None, 1) for i, n in enumerate(names)] + [(1, "Ｚuskuš", None, 1)], ENTRIES)
    assert sorted(tuple(r) for r in same_look(df, roster).collect()) == [(1, 1), (1, 1), (3, 1), (6, 2), (11, 3), (13, 5)]
    assert same_look(df.limit(0), roster).count() == 0 and same_look(df, roster.limit(0)).count() == 0


def test_to_members(spark, roster):
    names = {"FERAL COBRA": 2, "12. R3 [TAG]Feral Cobar": 2, "Feral": -1, "Captain12": None, "captain-13": 4, "Captain14": -1, "Longernmae Hree": 8, "ВЕДРО": 5, "???": -1, " ": None, "Captian12": 3, "Feral Cobra1": -1}
    df = spark.createDataFrame([(i, n, [{"player_name": "feral cobra", "score": 1}, None, {"player_name": None, "score": 2}] if i == 0 else None, 1) for i, n in enumerate([*names, None])], ENTRIES)
    got = {(r.entry_id, r.cand_ord): r.member_id for r in to_members(df, roster).collect()}
    want = {(i, -1): m for i, m in enumerate(names.values()) if m is not None}
    assert got == want | {(0, 0): 2}
    assert values(df.limit(0)).count() == 0
    assert {r.member_id for r in to_members(df, roster.limit(0)).collect()} == {-1}


def test_paths_and_all_entries_within_distance():
    assert paths("51 R5 [SaBr] Name") == ["51 R5 [SaBr] Name", "R5 [SaBr] Name", "[SaBr] Name", "Name"]
    assert Reference([(1, "Abcdefghi"), (2, "Abcdefghj"), (3, "Xyz")]).within("abcdefghk") == {1: 1, 2: 1}
    assert Reference([(1, "Abcdefghi"), (2, "Abcdefghj")]).closest("abcdefghk") == (1, 1)


def test_all_entries_within_distance_against_brute_force(spark, roster):
    names = ["Longername Here", "longernmae hre", "Captain12", "Captian13", "Feral", None, " ", "Feral Cobra", "feral cobras"]
    df = spark.createDataFrame([(i, n, None, 1) for i, n in enumerate(names + names[:2])], ENTRIES)
    got = {(r.value, r.n, r.member_id, r.errors) for r in within(df, roster).collect()}
    assert got == {("Longername Here", 2, 8, 0), ("longernmae hre", 2, 8, 2), ("Captain12", 1, 3, 0), ("Captian13", 1, 4, 1), ("Feral Cobra", 1, 2, 0), ("feral cobras", 1, 2, 1)}


NICKS = [("Mandi", "Solabaus"), ("Kray", "Krarikam"), ("Traelo", "Dekrind"), ("Trano", "Greitril")]


def test_readings_of_typed_names():
    n = GivenNames(NICKS)
    full = ("krarikam", "thousmonas")
    for name in ("Krarikam Thousmonas", "Thousmonas, Krarikam", "KrarikamThousmonas", "thousmonas krarikam", "KRAY THOUSMONAS", "krraythousmonas", "Thousmonas Krarikma"):
        assert read_name(name, n)[0] == full, name
    assert read_name("Thousmonas, Tralo", n) == [("dekrind", "thousmonas"), ("greitril", "thousmonas")]
    assert read_name("K. Thousmonas", n) == [("k", "thousmonas")] and read_name("!", n) == [] and read_name("word", n) == [("", "word")]


def test_very_long_names(spark, roster):
    long = "krarikam" + "x" * 20_000
    n = GivenNames(NICKS)
    assert read_name(long, n) == [("krarikam", "x" * 20_000)] and read_name("y" * 20_000, n) == [("", "y" * 20_000)]
    df = spark.createDataFrame([(1, long, 7, "typed"), (2, "Krarikam " + "x" * 20_000, 7, "typed"), (3, "z" * 9000, 7, "typed")], "entry_id long, player_name string, server_id int, entry_mode string")
    assert [tuple(r) for r in variants(df, spark.createDataFrame(NICKS, "nick string, full_given string")).collect()] == [(1, 2)]
    e = spark.createDataFrame([(1, long, None, 1), (2, "Feral " * 5_000, None, 1)], ENTRIES)
    assert {r.member_id for r in to_members(e, roster).collect()} == {-1} and within(e, roster).count() == 0


def test_variants(spark):
    same = ["Krarikam Thousmonas", "thousmonas, krarikam", "K. Thousmonas", "Kray Thsmns", "KrarikamThousmnas", "Krarikam Thousmonas"]
    other = ["Solabaus Thousmonas", "Krarikam Gritigeind"]
    rows = [(i, n, 7, "typed") for i, n in enumerate(same + other)] + [(20, same[1], 8, "typed"), (21, same[1], 7, "ocr"), (22, None, 7, "typed"), (23, " ", 7, "typed"), (None, same[1], 7, "typed"), (24, same[1], None, "typed")]
    df = spark.createDataFrame(rows, "entry_id long, player_name string, server_id int, entry_mode string")
    nicks = spark.createDataFrame(NICKS + [(None, "x")], "nick string, full_given string")
    got = {tuple(r) for r in variants(df, nicks).collect()}
    assert got == {(i, j) for i in range(6) for j in range(i + 1, 6) if same[i] != same[j]}
    assert variants(df.limit(0), nicks).count() == 0


def test_variants_of_given_names_that_no_table_knows(spark):
    """Initials, turned, joined, misspelt and abbreviated names of players whose given names aren't among the short forms."""
    people = [("Bartholomew", "Thousmonas"), ("Benedikt", "Oakley"), ("Wilhelmina", "Gritigeind"), ("Gustav", "Prestorim")]
    spelt = lambda g, f: [f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{f} {g}", f"{g}{f}", f"{g}{f}".lower(), f"{g[:3]}{g[4:]} {f}", f"{f[:4]}{f[5:]} {g}", f"{g} {f[:4]}.", f"{f}, {g[0]}."]
    rows = [(100 * k + i, n, 7, "typed") for k, (g, f) in enumerate(people) for i, n in enumerate(spelt(g, f))]
    rows += [(900, "Gertraud Thousmonas", 7, "typed"), (901, "Bartholomew Thousmonas", 8, "typed")]
    df = spark.createDataFrame(rows, "entry_id long, player_name string, server_id int, entry_mode string")
    nicks = spark.createDataFrame([("Bob", "Boromir"), ("Will", "Wolfram")], "nick string, full_given string")
    got = {tuple(r) for r in variants(df, nicks).collect()}
    want = {(100 * k + i, 100 * k + j) for k in range(len(people)) for i in range(10) for j in range(i + 1, 10) if rows[10 * k + i][1] != rows[10 * k + j][1]}
    assert got - want == set() and len(got & want) >= 0.9 * len(want), sorted(want - got)
    of = {r.entry_id: r.player for r in members(df, nicks).collect()}
    assert len(of) == len(rows) and {(a, b) for a in of for b in of if a < b and of[a] == of[b] and rows[0]} >= got


def test_radius_join_loses_no_pair(spark):
    words = sorted(set(random_words(120, "abcde", 9, 8)) - {""})
    df = spark.createDataFrame([(1, w) for w in words], "server_id long, text string")
    got = {(r.text, r.other): r.distance for r in radius_join(df, df, 2, words[:6]).collect()}
    assert got == {(a, b): d for a in words for b in words if (d := distance(a, b, swaps=False)) <= 2}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(31, 30), (40, 40)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {i: 1 for i in range(1, 21)} | {30: 30, 31: 30}
