import random

from pyspark.sql import functions as F
from test_records import SCHEMA, brute, captures

from rankloom.llm import arrivals as A


def test_arrivals_read_compacted_runs(spark, monkeypatch):
    runs, add = [], A.History.add

    def counted(self, accepted):
        add(self, accepted)
        runs.append((self.made, len(self.runs)))

    monkeypatch.setattr(A.History, "add", counted)
    rows = captures(150, 5)
    got = {tuple(r) for r in A.arrivals(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    # the fifth run and the four before it became one, and a slice came after that
    assert runs == [(1, 1), (2, 2), (3, 3), (4, 4), (6, 1), (7, 2)]


def test_reads_grow_with_the_batch_and_not_with_history(spark, monkeypatch):
    """Rows that the scan of the history gives, before any join, for batches of few captures and of many."""
    monkeypatch.setattr(A, "SPAN_ROWS", 64)
    rnd = random.Random(3)

    def rows(n, at):
        return spark.createDataFrame([(at + i, 1, f"{rnd.getrandbits(256):064x}", rnd.getrandbits(62), rnd.getrandbits(62)) for i in range(n)], "id long, batch long, digest string, high long, low long")

    def read(history, batch):
        keys = batch.select(F.explode(A.first_keys()["key"]).alias("key")).distinct()
        df = history.scan(keys)
        df.collect()
        leaves, total = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
        for i in range(leaves.size()):
            total += leaves.apply(i).metrics().apply("numOutputRows").value()
        return total

    small, large = A.History(spark), A.History(spark)
    small.add(rows(300, 0))
    large.add(rows(2400, 0))
    assert large.runs[0].bits > small.runs[0].bits
    few, many = rows(2, 9000), rows(200, 9000)
    a, b, c = read(small, few), read(large, few), read(large, many)
    assert 0 < b <= 2 * a + 64 and b < 0.1 * 2400 * 6 and c > 5 * b


def test_many_jittered_copies_of_one_screen(spark, monkeypatch):
    """More fingerprints of a screen than a window may hold in one batch: they are compared with the first ones, not all with all."""
    monkeypatch.setattr(A, "WINDOW", 8)
    rnd = random.Random(4)
    base = rnd.getrandbits(128)
    jitter = lambda: base ^ (1 << rnd.randrange(128)) ^ (1 << rnd.randrange(128)) ^ (1 << rnd.randrange(128))
    rows = [(i, i // 40, f"{i:064x}", f"{jitter():032x}") for i in range(160)]
    got = {tuple(r) for r in A.arrivals(spark.createDataFrame(rows, SCHEMA), slices=2).collect()}
    assert got == brute(rows)
