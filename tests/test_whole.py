"""Queries over all their rows, against plain Python on the same tables."""

from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rankloom.config import screen
from rankloom.operators.players import extract_players
from rankloom.plans import boards, rasters, registry
from rankloom.plans.pipeline import process
from rankloom.sources.captures import ANNOTATION


def lead(parts):
    """(brand, label) of the labels that lead the next of their brand by the gap, over all parts."""
    most = defaultdict(lambda: defaultdict(float))
    for key, brand, size in parts:
        label = f"t{key % 7}"
        most[brand][label] = max(most[brand][label], max(size * 5 % 256, key % 256, key * 7 % 256) / 255.0)
    out = set()
    for brand, of in most.items():
        first, *rest = sorted(((v, label) for label, v in of.items()), reverse=True)
        if not rest or first[0] - rest[0][0] >= 0.004:
            out.add((brand, first[1]))
    return out


def test_brightness_argmax_gap_reads_all_parts(spark, sf):
    t = pq.read_table(f"{sf}/part.parquet", columns=["p_partkey", "p_brand", "p_size"])
    parts = list(zip(*(c.to_pylist() for c in t.columns)))
    whole, thinned = lead(parts), lead([p for p in parts if p[0] % 11 == 0])
    assert whole != thinned
    assert {tuple(r) for r in registry.queries()["brightness_argmax_gap"](spark, sf).collect()} == whole


def test_gap_of_words_follows_the_width_of_the_image(spark, words):
    given = [("Iron", 100, 600), ("Wolf", 160, 600), ("50,000", 400, 600)]  # 20 pixels between the words of the name
    sized = None
    for image_id, width in enumerate((1080, 1440, 2208, 0, None)):
        one = words(*given, image_id=image_id).withColumn("width", F.lit(width).cast("int"))
        sized = one if sized is None else sized.unionByName(one)
    got = {r.image_id: r.player_name for r in extract_players(sized, 2400, F.col("width")).collect()}
    assert got == {0: "Iron Wolf", 1: "IronWolf", 2: "IronWolf", 3: "Iron Wolf", 4: "Iron Wolf"}


def test_pipeline_passes_the_width_of_each_capture(spark):
    def word(text, x, y=600):
        box = {"vertices": [{"x": x - 20, "y": y - 10}, {"x": x + 20, "y": y + 10}]}
        return {"symbols": [{"text": text, "bounding_box": None}], "boundingbox": None, "bounding_box": box}

    line = [word("Weekly", 50, 30), word("Rank", 120, 30), word("Iron", 100), word("Wolf", 160), word("50,000", 400)]
    tree = {"text": "", "pages": [{"width": None, "height": None, "blocks": [{"paragraphs": [{"words": line, "boundingbox": None}], "boundingbox": None}]}]}
    df = spark.createDataFrame([(1, 1080, 2400, tree), (2, 1440, 2400, tree)], f"capture_id bigint, image_width int, image_height int, annotation {ANNOTATION}")
    for override in (None, "friday"):
        assert {r.image_id: r.player_name for r in process(df, override=override).collect()} == {1: "Iron Wolf", 2: "IronWolf"}


def test_capture_players_with_the_gap_of_each_image(spark, sf):
    """The SQL of the rows with each capture's own gap in place of the fixed one."""
    gap = "(SELECT greatest(8, CAST(trunc(0.015 * CAST(image_width AS DOUBLE)) AS INTEGER)) FROM fixture WHERE capture_id = image_id)"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW fixture AS SELECT * FROM read_parquet('{sf}/fixture.parquet')")
    sql = "WITH {} SELECT image_id, anchor_ord, player_name, score FROM p"
    read = lambda g: sorted(db.execute(sql.format(boards.board(boards._CAPTURE_WORDS, up="a.up", down="a.down", edges=True, gap=g))).fetchall())
    assert read(gap) != read(16)
    got = sorted(tuple(r) for r in registry.queries()["capture_players"](spark, sf).select("image_id", "anchor_ord", "player_name", "score").collect())
    assert got == read(gap)


def regions(words, tabs):
    """(category, left, top, right, bottom) of each tab whose label is among (text, left, top); a word is 20 wide and 4 high."""
    out = set()
    for tab in tabs.items:
        signals = [s.lower().split() for s in tab.signals]
        one = next((w for s in signals for w in words if all(p in w[0].lower() for p in s)), None)
        found = [one] if one else next((c for s in signals if len(s) > 1 for w in words if (c := chain(w, s, words))), None)
        if found:
            out.add((tab.category, min(w[1] for w in found), min(w[2] for w in found), max(w[1] for w in found) + 20, max(w[2] for w in found) + 4))
    return out


def chain(first, signal, words):
    if signal[0] not in first[0].lower():
        return None
    used = [first]
    for part in signal[1:]:
        fit = [w for w in words if w not in used and part in w[0].lower() and abs(w[2] - first[2]) <= 8 and w[1] >= used[-1][1] + 20 - 4]
        if not fit:
            return None
        used.append(min(fit, key=lambda w: w[1]))
    return used


def test_find_tab_region_reads_all_screens(spark, sf):
    ids = pq.read_table(f"{sf}/customer.parquet", columns=["c_custkey"]).column(0).to_pylist()
    tabs = screen("alliance_contribution").tabs
    want = {(n, *r) for n in ids for r in regions(rasters.drawing(n)[0], tabs)}
    assert {n % 3 for n, *_ in want} == {0, 1, 2}
    rows = registry.queries()["find_tab_region"](spark, sf).select("image_id", "category", "left_x", "top_y", "right_x", "bottom_y").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
