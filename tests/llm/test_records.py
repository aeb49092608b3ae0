import random
import re
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import arrivals as A
from rankloom.llm.formats import collapse, copies, repeat_filter
from rankloom.llm.formats import _has, _positions
from rankloom.llm.mixing import make_plan, mix, permute, shares


def brute(rows):
    """(smallest accepted id, id) of each repeat, one capture after another."""

    def digest(s):
        t = re.sub(r"^(0x|sha256=?)", "", re.sub(r"[\s:\-_]", "", (s or "").lower()))
        return t if re.fullmatch("[0-9a-f]{64}", t) else None

    accepted, out = [], set()
    for c, b, s, d in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        s, d = digest(s), int(d, 16) if d else None
        hit = [a for a, x, y in accepted if (s is not None and s == x) or (d is not None and y is not None and (d ^ y).bit_count() <= 4)]
        if hit:
            out.add((min(hit), c))
        else:
            accepted.append((c, s, d))
    return out


def captures(n, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(128) for _ in range(4)]
    half = rnd.getrandbits(64)
    rows = []
    for i in range(n):
        d = rnd.choice(base) if rnd.random() < 0.6 else (half << 64) | rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 5)):
            d ^= 1 << rnd.randrange(128)
        s = f"{rnd.randrange(40):064x}"
        s = rnd.choice([s, s.upper(), "0x" + s, " " + s, s[:16] + "-" + s[16:], "sha256:" + s, None, "broken"])
        rows.append((i + 1, rnd.choice([None, *range(1, 9)]), s, rnd.choice([f"{d:032x}", f"{d:032X}", None]) if rnd.random() < 0.9 else None))
    return rows


SCHEMA = "capture_id long, batch_seq long, image_hash string, image_dhash string"


@pytest.mark.parametrize("few, window", [(20_000, 256), (0, 3)])
def test_arrivals_against_brute_force(spark, monkeypatch, few, window):
    monkeypatch.setattr(A, "SETTLED", few)
    monkeypatch.setattr(A, "WINDOW", window)
    rows = captures(120, window)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in A.arrivals(df, slices=2).collect()} == brute(rows)


def test_arrivals_of_nothing_and_of_copies(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert A.arrivals(empty, slices=2).count() == 0
    rows = [(i, i % 3, "a" * 64, "f" * 32) for i in range(30)] + [(None, 1, "a" * 64, None), (100, 1, None, None), (101, 1, None, None)]
    got = {tuple(r) for r in A.arrivals(spark.createDataFrame(rows, SCHEMA), slices=2).collect()}
    assert got == {(0, i) for i in range(1, 30)}


def test_five_parts_leave_one_untouched():
    parts = A._parts(list(range(128)))
    assert sorted(sum(parts, [])) == list(range(128)) and len(parts) == A.MOST_BITS + 1


PAYLOADS = [
    '{"player_name":"Ann B","score":1000,"category":"power","source_file":"a.png"}',
    "SCORE=1,000; Player_Name=ann-b; Category=Power ; source_file=A.PNG",
    '{\n "source_file": "a png", "player_name": "ANN_B!", "category": "power", "score": "1\'000" }',
    "player_name: Ann B\nscore: 1001\ncategory: power\nsource_file: a.png",
    '{"player_name": "Ann C", "score": null}',
    "Player Name = Ann C",
    None, "", "  ", "{}", "no fields here", '{"other": 1}', '{"broken',
]


def test_formats(spark):
    rows = [(i, p, "k") for i, p in enumerate(PAYLOADS)] + [(None, PAYLOADS[0], "k"), (0, PAYLOADS[0], "k")]
    df = spark.createDataFrame(rows, "raw_id long, payload string, key string")
    assert {tuple(r) for r in copies(df).collect()} == {(0, 1), (0, 2), (4, 5)}
    assert Counter(r.n_copies for r in collapse(df).collect()) == {5: 1, 1: 1, 2: 1}
    assert copies(df.limit(0)).count() == 0 and collapse(df.limit(0)).count() == 0


def test_ranges_of_hashes_shuffle_few_that_are_met_once(spark, monkeypatch):
    """A cap far below what one filter would need: the rows go to ranges, the result stays and few single records are shuffled."""
    from rankloom.llm import formats as R

    rows = [(i, f"player_name: p{i % 8500}; score: {i % 8500}") for i in range(9000)]
    df = spark.createDataFrame(rows, "raw_id long, payload string").repartition(3)
    monkeypatch.setattr(R, "MOST_BITS", 1 << 16)
    assert R.filter_bits(9000) == (1 << 16, 4) and R.filter_bits(0) == (1 << 16, 1)
    repeats, once, total = R.split_repeats(df)
    assert total == 9000 and repeats.count() + once.count() == 9000
    assert 0 <= repeats.count() - 1000 < 0.05 * 8000
    assert {tuple(r) for r in copies(df).collect()} == {(i, i + 8500) for i in range(500)}
    assert Counter(r.n_copies for r in collapse(df).collect()) == {2: 500, 1: 8000}


def test_filter_has_every_repeat(spark):
    rnd = np.random.default_rng(1)
    once, twice = rnd.integers(-(1 << 62), 1 << 62, 2000), rnd.integers(-(1 << 62), 1 << 62, 300)
    df = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "h long").repartition(5)
    f = repeat_filter(df, 1 << 17)
    assert _has(f, _positions(twice, 1 << 17)).all() and _has(f, _positions(once, 1 << 17)).mean() < 0.05


def test_permutation_and_its_way_back():
    for n in (1, 2, 3, 10, 1000):
        p = permute(np.arange(n), n, 9)
        assert sorted(p) == list(range(n)) and (permute(p, n, 9, back=True) == np.arange(n)).all()


def test_plan_reaches_shares_under_caps():
    p = make_plan({"a": 10_000, "b": 1_000, "c": 5}, {"a": (0.5, 1), "b": (0.4, 2), "none": (0.1, 1)}, block=10)
    assert p.names == ["a", "b"] and p.quotas.tolist() == [250, 200]
    assert make_plan({}, {"a": (1.0, 1)}).slots == 0


def test_mix(spark):
    docs = [(i, f"word{i} " * 200, "big", None) for i in range(30)] + [(100 + i, f"small {i} " * 60, "small", None) for i in range(3)] + [(200, "x", None, None), (201, None, "big", None), (202, "y", "unlisted", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, ids int")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("gone", 0.2, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mix(df, t).collect()
    used = Counter((r.source, r.block) for r in got)
    assert max(v for (s, _), v in used.items() if s == "small") <= 3 and max(v for (s, _), v in used.items() if s == "big") == 1
    assert all(len(r.ids) == r.n_tokens for r in got) and len({(r.shard, r.slot) for r in got}) == len(got)
    report = {r.source: r for r in shares(df, t).collect()}
    assert set(report) == {"big", "small", "gone", "unlisted", None} and report["gone"].share == 0 and report["unlisted"].target_share == 0
    assert abs(report["small"].share - 0.4) < 0.12 and sum(r.tokens for r in report.values()) == sum(r.n_tokens for r in got)
    assert mix(df.limit(0), t).count() == 0 and mix(df, t.limit(0)).count() == 0


def test_mix_is_the_same_however_files_are_split(spark, tmp_path):
    docs = [(i, f"word{i} " * (50 + i % 7), ("big", "small")[i % 3 == 0], "p" * 50) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, pad string").coalesce(1)
    df.write.option("parquet.block.size", 16384).option("parquet.page.size", 4096).parquet(str(tmp_path / "docs"))
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = []
    for least in (8, 1):
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        d = spark.read.parquet(str(tmp_path / "docs"))
        got.append((d.rdd.getNumPartitions(), sorted((r.shard, r.slot, r.source, r.block, r.ids) for r in mix(d, t).collect())))
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0][1] == got[1][1] and got[0][1]
    assert got[0][0] > got[1][0] == 1


def test_shares_are_met_and_no_document_is_used_too_often(spark):
    """The tokens of the mix turned back to text: a mark that each document has once, counted over all its uses."""
    from rankloom.llm.tokens import vocabulary

    rnd = random.Random(6)
    docs = [(i, f" <{i}>" + "".join(f" word{rnd.randrange(999)}" for _ in range(rnd.randrange(20, 400))), "big" if i < 500 else "small") for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.3, 1), ("small", 0.7, 4)], "source string, target_share double, max_repeats int")
    text = {v: k for k, v in vocabulary(spark).value.ranks.items()}
    used, tokens = Counter(), Counter()
    for r in mix(df, t).collect():
        tokens[r.source] += len(r.ids)
        used.update(re.findall(r"<(\d+)>", b"".join(text[i] for i in r.ids).decode("utf-8", "replace")))
    assert max(n for i, n in used.items() if int(i) < 500) == 1
    assert max(n for i, n in used.items() if int(i) >= 500) == 4 and len(used) > 300
    assert abs(tokens["small"] / sum(tokens.values()) - 0.7) < 0.02
